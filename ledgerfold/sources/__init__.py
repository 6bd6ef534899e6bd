"""Readers and stored tables."""

from .readers import (
    content_fingerprint, file_fingerprints, normalize_headers, read_csv, read_json_records,
    read_source, read_sql, read_tsv, source_metadata,
)
from .store import Store

__all__ = [
    "Store", "content_fingerprint", "file_fingerprints", "normalize_headers", "read_csv",
    "read_json_records", "read_source", "read_sql", "read_tsv", "source_metadata",
]
