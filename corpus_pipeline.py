"""The corpus pipeline: stages that each call one operator of `ledgerfold.llm`.

A stage takes the documents that the one before has kept, written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.scratch import stage
from ledgerfold.llm.bpe import encode, vocabulary_path
from ledgerfold.llm.common import KEY, positional, rows_not_in, with_row_key
from ledgerfold.llm.exact import exact_dedup
from ledgerfold.llm.language import UNKNOWN, detect, documents_model
from ledgerfold.llm.mixing import mix
from ledgerfold.llm.simhash import near_duplicates


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that no learned language is found for: null texts, texts without a letter.

    Very long texts are read whole. Repeated rows and ties are judged alike. If
    nothing can be learned (no row has a text and a language) no language is
    known and no document stays; an empty table gives no rows. Columns stay as
    they are, others than those of documents, too.
    """
    found = detect(spark, documents_model(docs), F.col("text"))
    return docs.filter(found["lang_pred"] != UNKNOWN)


def _without(docs: DataFrame, dropped: Callable[..., DataFrame]) -> DataFrame:
    """`docs` without the rows whose keys `dropped` gives; its own columns can have any names."""
    rows = with_row_key(positional(docs))
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    keys = dropped(rows, id_col=place["doc_id"], text_col=place["text"], keyed=True).select(*KEY)
    return rows_not_in(rows, keys).select(*place.values()).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are equal. A null id is smallest; of several rows with
    the largest id, the first in the stored input stays. Very long texts are
    compared whole. An empty table gives no rows. Columns stay as they are,
    others than those of documents, too, whatever their names.
    """
    return _without(docs, lambda rows, **names: exact_dedup(rows, **names).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, the row with the smallest doc_id.

    Null and empty texts have fingerprint zero. Rows with a null id stay only
    where no other is linked; of several rows with the smallest id, the first in
    the stored input stays. Very long texts are read whole. An empty table gives
    no rows. Columns stay as they are, others than those of documents, too,
    whatever their names.
    """
    return _without(docs, lambda rows, **names: near_duplicates(rows, **names).filter("not first"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0, null is a source of its own. Repeated ids
    and rows are documents of their own. Very long texts count whole, and none
    is taken more than twice. An empty table gives no rows. Columns stay as they
    are, others than those of documents, too, whatever their names.
    """
    return mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number and digest, and the digest of the decoded text.

    One row per row of `docs`, also for null ids and repeated rows; a null text
    is empty and has no ids. Very long texts are encoded in parts, and the result
    is that of the whole. An empty table gives no rows. Other columns are ignored.
    """
    encoded = encode(docs, vocabulary_path(), decoded=True)
    return encoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language id", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding and decoding", encode_texts),
]

# Learned language filters, fingerprint bits and byte-pair merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, work) in enumerate(STAGES):
        docs = work(spark, stage(docs, f"stage-{place}") if place else docs, sf_dir)
    return docs
