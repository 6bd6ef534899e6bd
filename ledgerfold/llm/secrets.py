"""Secrets in texts: fixed patterns, and strings that pass tests of randomness.

Any long run of encoding characters is a candidate, and so is a long part of it
between signs, as in paths. Its characters tell which
encoding it may be; in that alphabet it must pass a battery: chi-squared test of
uniformity, runs test about the alphabet's middle, serial correlation of
neighbours. What passes is tested against the opposite, that it is ordinary
writing in these characters: its p-value says how likely writing of that length
would look as uniform, and in alphabets of one case would change as often between
letters and digits, so short strings prove little. Over all documents, the
candidates of a length class that pass are found such that the expected share of
false ones stays below a bound (Benjamini-Hochberg by counts of p-values). Each
different string is one test, however often it is there.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, named, released, slices, with_row_key
from .queries import QUERIES, table

# The base patterns with their least lengths, in order.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
# Candidates, their parts between signs, and the encodings they may be in: name, characters, classes that must occur.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
LONG_WORD = 20
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", DIGITS + "abcdef", (DIGITS, LOWER)),
    ("hex", DIGITS + "ABCDEF", (DIGITS, UPPER)),
    ("base32", UPPER + "234567", (DIGITS, UPPER)),
    ("base32", LOWER + "234567", (DIGITS, LOWER)),
    ("base36", UPPER + DIGITS, (DIGITS, UPPER)),
    ("base36", LOWER + DIGITS, (DIGITS, LOWER)),
    ("base52", UPPER + LOWER, (UPPER, LOWER)),
    ("base62", UPPER + LOWER + DIGITS, (DIGITS, UPPER, LOWER)),
    ("base64", UPPER + LOWER + DIGITS + "+/", (DIGITS, UPPER, LOWER)),
    ("base64url", UPPER + LOWER + DIGITS + "-_", (DIGITS, UPPER, LOWER)),
)
# Sum of squared shares of the characters in ordinary writing: letters in English, and decimal digits.
LETTER_REPEAT, DIGIT_REPEAT = 0.0655, 0.1
# Share of neighbours in ordinary writing that are a letter and a digit: words and numbers have some five characters.
# It counts for alphabets of one case, up to this size: of few characters, evenness alone tells little.
CHANGE_SHARE = 0.2
ONE_CASE = 36
# Parameter: bytes of text handled at once.
CHUNK = 1_000_000
# Parameters: least combined p-value of the battery, expected share of false finds, length classes, p-value classes.
LEAST_BATTERY_P = 0.001
FALSE_SHARE = 0.01
LENGTH_CLASSES = (20, 32, 48, 96)
P_CLASSES_PER_DECADE = 4
MOST_DECADES = 40


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_tail(x: float, freedom: int) -> float:
    """P(chi-squared >= x), by Wilson and Hilferty's cube root."""
    share = 2 / (9 * freedom)
    return _upper_tail(((max(x, 0.0) / freedom) ** (1 / 3) - 1 + share) / math.sqrt(share))


def _statistic(places: list[int], size: int) -> float:
    return size / len(places) * sum(c * c for c in Counter(places).values()) - len(places)


def battery(places: list[int], size: int) -> float:
    """Combined p-value that `places` are random in an alphabet of `size`: least of the three, times three."""
    n = len(places)
    spread = _chi_squared_tail(_statistic(places, size), size - 1)
    upper = [2 * p >= size for p in places]
    high = sum(upper)
    runs = 1 + sum(a != b for a, b in zip(upper, upper[1:]))
    if 0 < high < n:
        both = 2 * high * (n - high)
        deviation = math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9))
        runs_p = 2 * _upper_tail(abs(runs - both / n - 1) / deviation)
    else:
        runs_p = 2.0 ** (1 - n)
    mean = sum(places) / n
    around = sum((p - mean) ** 2 for p in places)
    serial = sum((a - mean) * (b - mean) for a, b in zip(places, places[1:])) / around if around else 1.0
    serial_p = 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(spread, runs_p, serial_p))


def _evenness(places: list[int], size: int) -> tuple[float, float]:
    """How many deviations the use of the alphabet is more even than in ordinary writing, and those of a random string."""
    n = len(places)
    excess = size * (DIGIT_REPEAT if size <= 16 else LETTER_REPEAT) - 1
    deviation = math.sqrt(2 * (size - 1) + 4 * n * excess)
    return (size - 1 + (n - 1) * excess - _statistic(places, size)) / deviation, (n - 1) * excess / deviation


def _changes(text: str, alphabet: str) -> tuple[float, float]:
    """The same for neighbours of which one is a letter and one a digit."""
    pairs, digits = len(text) - 1, sum(c in DIGITS for c in alphabet) / len(alphabet)
    deviation = math.sqrt(pairs * CHANGE_SHARE * (1 - CHANGE_SHARE))
    changes = sum((a in DIGITS) != (b in DIGITS) for a, b in zip(text, text[1:]))
    return ((changes - 0.5 - pairs * CHANGE_SHARE) / deviation,
            pairs * (2 * digits * (1 - digits) - CHANGE_SHARE) / deviation)


def _writing_tail(z: float) -> float:
    return max(_upper_tail(z), 10.0 ** -MOST_DECADES)


def writing_p(places: list[int], size: int) -> float:
    """How likely ordinary writing of this length has so even a use of the alphabet."""
    return _writing_tail(_evenness(places, size)[0])


def string_p(text: str, alphabet: str) -> float:
    """`writing_p` of a string; in one case, both deviations weighted by those of random strings (Stouffer)."""
    even, even_weight = _evenness([alphabet.index(c) for c in text], len(alphabet))
    if len(alphabet) > ONE_CASE:
        return _writing_tail(even)
    changes, weight = _changes(text, alphabet)
    return _writing_tail((even_weight * even + weight * changes) / math.hypot(even_weight, weight))


def inferred(text: str) -> str | None:
    """The smallest alphabet that the string is in and uses all classes of; None if there is none."""
    used = set(text)
    for _, alphabet, classes in ENCODINGS:
        if used <= set(alphabet) and all(used & set(c) for c in classes):
            return alphabet
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds as numbers."""
    spans = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LENGTH]
    if any(len(word) >= LONG_WORD for word in text.split()):
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _tested(text: str) -> float | None:
    """The p-value against writing of a string that passes the battery of its alphabet."""
    alphabet = inferred(text)
    if alphabet and battery([alphabet.index(c) for c in text], len(alphabet)) >= LEAST_BATTERY_P:
        return string_p(text, alphabet)
    return None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value against writing) of the strings outside base spans that pass the battery.

    A run of candidate characters may be one string, or a path or name with
    strings between its signs: the whole run is tested, and each long part of it.
    Parts are taken if one is less likely to be writing than the whole. Each
    p-value is multiplied by the number of tests of its run.
    """
    found = []
    if not any(len(word) >= LONG_WORD for word in text.split()):
        return found
    for m in CANDIDATE.finditer(text):
        body = m[0].rstrip("=")
        if len(body) < LONG_WORD or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        strings = [(0, len(body)), *(x.span() for x in PART.finditer(body) if len(x[0]) < len(body))]
        tested = [(m.start() + i, m.start() + j, _tested(body[i:j])) for i, j in strings]
        whole, parts = tested[0], [x for x in tested[1:] if x[2] is not None]
        if whole[2] is not None and all(whole[2] < x[2] for x in parts):
            parts = [whole]
        found += [(i, j, min(1.0, p * len(tested))) for i, j, p in parts]
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), signed=True)


def _scan(batches):
    base_kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    tested_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("hash", pa.int64())]))
    for batch in batches:
        for some in slices(batch, "text", CHUNK):
            texts = some.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            tested = [candidates(t, b) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_pydict({
                **{c: some.column(c) for c in [*KEY, "doc_id"]},
                "base": pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base], base_kind),
                "tested": pa.array([[{"start": a, "end": b, "p": p, "hash": _hash(t[a:b])} for a, b, p in x]
                                    for t, x in zip(texts, tested)], tested_kind)})


def _limits(tested: DataFrame, false_share: float) -> dict[int, float]:
    """Per length class the largest p-value that keeps the expected share of false finds among different strings."""
    counts = (
        tested.select("hash", "length_class", "p_class").distinct().groupBy("length_class", "p_class").agg(F.count("*").alias("n"))
        .orderBy("length_class", "p_class").collect()
    )
    limits = {}
    for length in {r["length_class"] for r in counts}:
        own = [r for r in counts if r["length_class"] == length]
        total, running = sum(r["n"] for r in own), 0
        for r in own:  # p-values of a class are at most its upper bound
            running += r["n"]
            bound = 10.0 ** (r["p_class"] / P_CLASSES_PER_DECADE)
            if bound <= false_share * running / total:
                limits[length] = bound
    return limits


def find_secrets(
    docs: DataFrame, false_share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: KEY, doc_id, base and spans.

    Both are arrays of (start, kind, end, name) in order; offsets count code points,
    the end is exclusive. `base` has the fixed patterns, `spans` those and the
    random strings. Null and empty texts have none. The p-value limits hold for
    the whole table, so a row's random strings depend on the others. Null and
    repeated ids don't matter; an empty table gives no rows; other columns are
    ignored. Texts are scanned whole, a few MB at a time; a longer one alone.
    """
    rows = with_row_key(docs).select(
        *KEY, named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = stage(rows.mapInArrow(
        released(_scan), f"{KEY[0]} long, {KEY[1]} long, doc_id {kind}, "
               "base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,p:double,hash:long>>"),
        "secret-candidates")
    length_class = lambda span: sum(
        ((span["end"] - span["start"]) >= least).cast("int") for least in LENGTH_CLASSES)
    each = scanned.select(F.explode("tested").alias("one")).select(
        "one.hash", length_class(F.col("one")).alias("length_class"),
        F.ceil(F.log10("one.p") * P_CLASSES_PER_DECADE).cast("int").alias("p_class"))
    limits = _limits(each, false_share)
    limit = lambda span: F.coalesce(
        *(F.when(length_class(span) == k, F.lit(v)) for k, v in limits.items()), F.lit(-1.0))
    kinds = F.array(*map(F.lit, KINDS))
    name = lambda s: F.struct(s["start"], s["kind"], s["end"], kinds[s["kind"]].alias("name"))
    random = F.transform(F.filter("tested", lambda s: s["p"] <= limit(s)), lambda s: name(
        F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))))
    base = F.transform("base", name)
    return scanned.select(*KEY, "doc_id", base.alias("base"), F.sort_array(F.concat(base, random)).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES["op5_secrets"] = op5_secrets
