"""All registered queries of this subpackage."""

from . import (  # noqa: F401  (importing registers the queries)
    bpe, clustering, exact, infill, language, mixing, preference, quality, records, secrets, simhash, substrings, warc,
)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
