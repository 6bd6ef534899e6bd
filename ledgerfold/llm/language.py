"""Language identification by bit-sliced Bloom filters of letter n-grams.

One table holds the filters of all languages: a slot is a bit mask with one bit
per language, and the AND of an n-gram's slots is the set of languages that have
it. A text's hits are counted per language, corrected for the false positives
that the fill of each filter predicts, and the highest count decides.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, give_back, named, released, slices, with_row_key
from .queries import QUERIES, table

UNKNOWN = "und"
# Parameters: labelled rows learned from per language (about), slots of the filters, occurrences an n-gram
# needs, and its share in a language against its largest share in any.
SAMPLE_ROWS = 4000
SLOT_BITS = 21
LEAST_COUNT = 3
LEAST_SHARE = 0.25
# Odd multipliers of the two hashes; languages per mask; letters or bytes handled at once.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MASK_LANGUAGES = 62
CHUNK = 1 << 18


@dataclass
class Filters:
    languages: list[str]  # in order of code points
    common: str | None  # the language of most learned rows
    masks: np.ndarray  # slots x mask words
    false_rates: np.ndarray  # per language
    letters: np.ndarray  # per code point


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool)


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and each text's number of them.

    An n-gram is a letter with the one before and the two after it, lower-cased;
    what isn't a letter is a blank, and nothing after a blank counts. So each
    letter gives one, also in a word of one letter.
    """
    joined = "".join(f"\n{t}\n\n" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table[codes]
    letters = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    third, fourth = letters[at + 1], letters[at + 2]
    parts = (letters[at - 1], letters[at], third, np.where(third == 0, np.uint64(0), fourth))
    hashes = np.zeros(len(at), np.uint64)
    for part, multiplier in zip(parts, MULTIPLIERS):
        hashes += part * np.uint64(multiplier)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(MULTIPLIERS[4])
    hashes ^= hashes >> np.uint64(32)
    ends = np.cumsum([len(t) + 3 for t in texts])
    return hashes, np.diff(np.searchsorted(at, ends), prepend=0)


def _chunks(texts: list[str]):
    """Neighbouring texts of about CHUNK letters in all; a longer text is in a chunk of its own."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - SLOT_BITS)
    return (hashes >> top).astype(np.int64), ((hashes << np.uint64(SLOT_BITS)) >> top).astype(np.int64)


def _count_grams(letters):
    def count(batches):
        for batch in batches:
            for number, texts in batch.groupby("number")["text"]:
                for chunk in _chunks([t.lower() for t in texts]):
                    grams, counts = np.unique(_grams(chunk, letters.value)[0], return_counts=True)
                    yield pd.DataFrame({"number": number, "gram": grams.view(np.int64), "n": counts})

    return count


def learn(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
    least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE,
) -> Filters:
    """Filters learned from about `sample_rows` rows of each language.

    A language's rows are chosen by a hash of their place in the stored input, so
    a rerun learns the same, and copies of a text count like any other rows. Rows
    with a null text or language teach nothing. Texts are read whole. Without
    labelled rows, as in an empty table, no language is known.
    """
    spark = labelled.sparkSession
    rows = with_row_key(labelled).select(
        *KEY, named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    found = {r["lang"]: r["n"] for r in sizes.collect()}
    languages = sorted(found)
    letters = letter_table()
    if not languages:
        return Filters([], None, np.zeros((1 << SLOT_BITS, 1), np.uint8), np.zeros(0), letters)
    spread = 1 << 30
    numbers = spark.createDataFrame(
        [(lang, i, min(spread, spread * sample_rows // found[lang] + 1)) for i, lang in enumerate(languages)],
        "lang string, number int, share long")
    # one row per language: far smaller than the filters, which hold 256 KB for each
    chosen = rows.join(F.broadcast(numbers), "lang").filter(F.pmod(F.xxhash64(*KEY), F.lit(spread)) < F.col("share")).select("number", "text")
    counts = stage(
        chosen.mapInPandas(released(_count_grams(spark.sparkContext.broadcast(letters))), "number int, gram long, n long")
        .groupBy("gram", "number").agg(F.sum("n").alias("n")), "gram-counts")
    shares = counts.join(counts.groupBy("number").agg(F.sum("n").alias("total")), "number").withColumn(
        "share", F.col("n") / F.col("total"))
    # a gram has one row per language at most
    members = (
        shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "n", "share")).alias("each"))
        .select("gram", F.explode(F.filter("each", lambda x: (x["n"] >= least_count) & (
            x["share"] >= F.col("most") * least_share))["number"]).alias("number"))
    )
    first = F.shiftrightunsigned("gram", 64 - SLOT_BITS)
    second = F.shiftrightunsigned(F.shiftleft("gram", SLOT_BITS), 64 - SLOT_BITS)
    slots = (
        members.select(F.explode(F.array(first, second)).alias("slot"), F.floor(F.col("number") / MASK_LANGUAGES).alias("word"),
                       F.expr(f"shiftleft(1L, number % {MASK_LANGUAGES})").alias("bit"))
        .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table_ = np.zeros((1 << SLOT_BITS, -(-len(languages) // MASK_LANGUAGES)), kind)
    table_[slots["slot"].to_numpy(np.int64), slots["word"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64).astype(kind)
    fills = [((table_[:, i // MASK_LANGUAGES] >> kind(i % MASK_LANGUAGES)) & kind(1)).mean()
             for i in range(len(languages))]
    return Filters(languages, max(languages, key=lambda x: found[x]), table_, np.array(fills) ** 2, letters)


def _scores(texts: list[str], model: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits per text and language, and n-grams per text."""
    grams, counts = _grams(texts, model.letters)
    first, second = _slots(grams)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hits = np.zeros((len(texts), len(model.languages)))
    for word in range(model.masks.shape[1]):
        column = model.masks[:, word]
        masks = column[first] & column[second]
        for i in range(word * MASK_LANGUAGES, min(len(model.languages), (word + 1) * MASK_LANGUAGES)):
            bit = ((masks >> masks.dtype.type(i % MASK_LANGUAGES)) & masks.dtype.type(1)).astype(np.int32)
            sums = np.concatenate([[0], np.cumsum(bit)])
            hits[:, i] = np.diff(sums[bounds])
    expected = counts[:, None] * model.false_rates
    return np.maximum(0, hits - expected) / (1 - np.minimum(model.false_rates, 0.999)), counts


def detect(spark: SparkSession, model: Filters, text: Column) -> Column:
    """A struct of lang_pred and score for a text column.

    The score is the share of the text's n-grams that the language has, corrected.
    Null, empty and letterless texts are `und` with score 0, and so are all texts
    if nothing was learned. Of equal languages the first by code points wins; a
    text without any known n-gram gets the most frequent language with score 0.
    """
    shared = spark.sparkContext.broadcast(vars(model))  # plain values, as workers need not know the class

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        known, langs, scores = Filters(**shared.value), [], []
        for some in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", CHUNK):
            hits, counts = _scores([(t or "").lower() for t in some.column("text").to_pylist()], known)
            for row, n in zip(hits, counts):
                best = int(row.argmax()) if n and len(row) else None
                value = min(1.0, float(row[best]) / n) if best is not None else 0.0
                langs.append(UNKNOWN if best is None else known.languages[best] if value else known.common)
                scores.append(value)
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out() -> Column:
    """Whether the contract keeps a row of `documents` out of learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def documents_model(docs: DataFrame) -> Filters:
    return learn(docs.filter(~held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = detect(spark, documents_model(docs), F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score")


QUERIES["op1_language_id"] = op1_language_id
