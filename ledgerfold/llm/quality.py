"""Quality rules in DataFrame functions: fixed rules, and divergence from a language's usual text.

A document's histograms of character classes and of common words are compared
with those of all documents of its language by Jensen-Shannon distance. Short
documents say too little and are kept, whatever their distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, SPACES, WORD, named, with_row_key
from .queries import ORACLES, QUERIES, table

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Common words per language. Those of another language are the words in most of its different texts.
MOST_COMMON = 25
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it as was with be by on not he his or",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
# Fixed value: parts of a share in a reference.
SHARE_UNITS = 1 << 24
# Parameters: largest distances (documents labelled good stay below 0.22 and 0.31, most labelled bad that the base
# rules miss lie above 0.31 and 0.33), words that a document needs for each.
MOST_CLASS_DISTANCE = 0.27
MOST_WORD_DISTANCE = 0.325
CLASS_WORDS = 50
COMMON_WORDS_NEEDED = 100


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda a, b: a + b)


def _repeated_windows(rows: DataFrame) -> DataFrame:
    """`rows` (with `words`) and n_repeat_words: words in windows that occur twice or more.

    Equal hashes only select the documents whose windows are then sorted as text.
    Later steps name the earlier ones' columns more than once, so that the
    optimizer evaluates each once per document.
    """
    others = [c for c in rows.columns if c != "words"]
    places = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)))
    single = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("single"))
    hashed = single.select("*", F.transform(places, lambda i: F.xxhash64(
        *(F.get("single", i + (k - 1)) for k in range(WINDOW)))).alias("hashes")).drop("single")
    window = F.transform(places, lambda i: F.struct(
        F.array_join(F.slice("words", i, WINDOW), " ").alias("window"), i.alias("at")))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = hashed.select(*others, F.when(repeated, F.sort_array(window)).alias("windows"))
    none = F.array(F.lit(None).cast("struct<window:string,at:int>"))
    beside = F.arrays_zip(
        F.col("windows").alias("own"),
        F.concat(none, F.slice("windows", F.lit(1), F.size("windows") - 1)).alias("before"),
        F.concat(F.slice("windows", F.lit(2), F.size("windows") - 1), none).alias("after"))
    twice = F.filter(F.when(F.col("windows").isNotNull(), beside), lambda x: (
        x["own"]["window"].eqNullSafe(x["before"]["window"]) | x["own"]["window"].eqNullSafe(x["after"]["window"])))
    starts = ordered.select(*others, F.sort_array(F.transform(twice, lambda x: x["own"]["at"])).alias("starts"))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda sofar, at: F.struct((sofar["n"] + F.least(F.lit(WINDOW), at - sofar["last"])).alias("n"), at.alias("last")),
        lambda sofar: sofar["n"])
    return starts.select(*others, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _counted(words: Column, word: Column) -> Column:
    """How often a word is in a text of words with two blanks before and after each."""
    return ((F.length(words) - F.length(F.replace(words, F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))))
            / (F.length(word) + 2)).cast("long")


def derived_words(rows: DataFrame) -> DataFrame:
    """lang and listed: the words in most different texts, of each language in `rows` (lang, text) without fixed ones.

    Copies of a text count once. Ties go by code points. Null is a language of
    its own. Texts are read where they lie: hashes tell which rows are copies,
    and only these, as keys, are joined with the rows.
    """
    keyed = rows if KEY[0] in rows.columns else with_row_key(rows)
    other = keyed.filter(F.coalesce(~F.col("lang").isin(*COMMON_WORDS), F.lit(True))).select(
        *KEY, F.coalesce(F.concat(F.lit("="), "lang"), F.lit("none")).alias("lang_key"), "lang", "text")
    hashes = stage(other.select(*KEY, "lang_key", F.xxhash64("text").alias("text_hash")), "other-languages")
    groups = hashes.groupBy("lang_key", "text_hash").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("first")).filter("n > 1")
    copies = stage(hashes.join(groups, ["lang_key", "text_hash"]).filter(F.struct(*KEY) != F.col("first")).select(*KEY), "copies")
    met = F.array_distinct(F.filter(
        F.transform(F.split("text", SPACES), lambda w: F.lower(w)), lambda w: w.rlike(r"\p{L}")))
    counts = other.join(copies, KEY, "left_anti").select("lang", F.explode(met).alias("word")).groupBy("lang", "word").agg(
        F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    first = counts.withColumn("place", place).filter(F.col("place") <= MOST_COMMON)
    return stage(first.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("listed")).select(
        F.col("lang").alias("listed_lang"), "listed"), "listed")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts of each row: those of the base rules, character classes, common words.

    A common word counts where it stands between white space, in either case.
    A language without fixed ones is measured by `derived_words`.
    """
    rows = with_row_key(docs).select(
        *KEY, named(id_col).alias("doc_id"), named(lang_col).cast("string").alias("lang"),
        F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = rows.join(derived_words(rows), F.col("lang").eqNullSafe(F.col("listed_lang")), "left").drop("listed_lang")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    split = rows.select(
        *KEY, "doc_id", "lang", "listed", F.xxhash64("text").alias("text_hash"), F.length("text").alias("chars"), lines.alias("lines"),
        F.regexp_replace("text", SPACES, "").alias("body"), F.array_remove(F.split("text", SPACES), "").alias("words"))
    everything = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    common = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.array(*map(F.lit, words.split()))).otherwise(common)
    common = F.coalesce("listed", common, F.array(*map(F.lit, everything)))
    lowered = F.transform("words", lambda w: F.lower(w))
    met = F.when(F.col("listed").isNull(), F.filter(lowered, lambda w: w.isin(*everything))).otherwise(
        F.filter(lowered, lambda w: F.array_contains("listed", w)))
    counted = split.select(
        *KEY, "doc_id", "lang", "text_hash", "words", F.size("words").cast("long").alias("n_words"),
        F.length("body").cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.col("chars") - F.length("body")).cast("long").alias("blanks"),
        F.regexp_replace("body", r"\p{Ll}+", "").alias("rest"), common.alias("common"),
        F.concat(F.lit("  "), F.array_join(met, "  "), F.lit("  ")).alias("met"))
    classed = counted.withColumn("unlettered", F.regexp_replace("rest", r"\p{L}+", "")).withColumn(
        "common", F.transform("common", lambda w: _counted(F.col("met"), w))).withColumn(
        "classes", F.array(
            "blanks", F.col("word_chars") - F.length("rest"),
            (F.length("rest") - F.length("unlettered")).cast("long"),
            (F.length("unlettered") - F.length(F.translate("unlettered", "0123456789", ""))).cast("long"),
            F.length(F.translate("unlettered", "0123456789", "")).cast("long")))
    found = _sum(F.col("common"), F.lit(0).cast("long"))
    whole = classed.select(
        *KEY, "doc_id", "lang", "text_hash", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "classes",
        F.concat("common", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - found))).alias("common"))
    return _repeated_windows(whole)


def distance(own: str, usual: str) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms in columns; 0 if one is empty.

    Their sums are in the columns `own`_sum and `usual`_sum.
    """
    own_sum, usual_sum = F.col(f"{own}_sum"), F.col(f"{usual}_sum")
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    both = lambda a, b: part(a, b) + part(b, a)
    bits = _sum(F.zip_with(own, usual, lambda a, b: both(a / own_sum, b / usual_sum)), F.lit(0.0)) / 2
    return F.when((own_sum > 0) & (usual_sum > 0), F.sqrt(F.greatest(bits, F.lit(0.0)))).otherwise(0.0)


def references(counts: DataFrame, each_text_once: bool = False) -> DataFrame:
    """lang, usual_classes and usual_common: the summed histograms of a language's rows.

    With `each_text_once` the mean shares of its different texts that pass the
    base rules: a text counts alike, however often it is there and however long
    it is. Shares are whole numbers, so that sums don't depend on their order.
    """
    if each_text_once:
        texts = counts.filter(~F.col("base_failed")).groupBy("lang", "text_hash").agg(
            F.any_value("classes").alias("classes"), F.any_value("common").alias("common"))
        total = lambda h: _sum(F.col(h), F.lit(0).cast("long"))
        share = lambda h: F.transform(h, lambda n: F.floor(n * SHARE_UNITS / F.col(f"{h}_sum"))).alias(h)
        counts = texts.withColumns({"classes_sum": total("classes"), "common_sum": total("common")}).select(
            "lang", share("classes"), share("common"))
    widest = 1 + len({w for words in COMMON_WORDS.values() for w in words.split()})
    summed = counts.groupBy("lang").agg(
        *(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(5)),
        *(F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(widest)))
    return summed.select(
        "lang", F.array(*(f"c{i}" for i in range(5))).alias("usual_classes"),
        F.filter(F.array(*(f"w{i}" for i in range(widest))), lambda x: x.isNotNull()).alias("usual_common"))


def quality(
    docs: DataFrame, class_limit: float = MOST_CLASS_DISTANCE, word_limit: float = MOST_WORD_DISTANCE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each_text_once: bool = False,
) -> DataFrame:
    """One row per row of `docs`: KEY, doc_id, the counts, both distances, base_failed and kept.

    The references are the summed histograms of all rows with the same language,
    which copies, junk and long texts can move; with `each_text_once`, as in the
    query, the mean shares of the different texts that pass the base rules
    (without any, the distances are 0). Null is a language of its own. A null text has
    no words; it and an empty text fail the base rules. Rows with the same id or
    text are judged alike. An empty table gives no rows. Other columns are ignored.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    counts = stage(features(docs, id_col, text_col, lang_col).withColumn(
        "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("none"))).withColumn("base_failed", failed), "quality")
    usual = references(counts, each_text_once)
    histograms = ["classes", "common", "usual_classes", "usual_common"]
    totals = {f"{h}_sum": _sum(F.col(h), F.lit(0).cast("long")) for h in histograms}
    compared = counts.join(usual, "lang", "left").withColumns(totals).select(
        *KEY, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance("classes", "usual_classes").alias("class_distance"),
        distance("common", "usual_common").alias("word_distance"))
    diverges = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > class_limit)) | (
        (F.col("n_words") >= COMMON_WORDS_NEEDED) & (F.col("word_distance") > word_limit))
    return compared.withColumn("kept", ~F.col("base_failed") & ~diverges)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), each_text_once=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op8_quality"] = op8_quality


def _oracle() -> str:
    """The same by unnested windows and histograms."""
    lists = {lang: words.split() for lang, words in COMMON_WORDS.items()}
    everything = sorted({w for words in lists.values() for w in words})
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    fixed = "CASE lang " + " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in lists.items()) + " END"
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos:pos + 4], ' ')) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs)),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + i) AS n_repeat_words
  FROM windows, (SELECT unnest(range(0, 5)) AS i) WHERE n > 1 GROUP BY doc_id),
lined AS (
  SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
         regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS body FROM docs),
classes AS (
  SELECT doc_id, len(text) - len(body) AS k0, len(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS k1,
         len(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) - k1 AS k2,
         len(regexp_replace(text, '[^0-9]+', '', 'g')) AS k3, len(body) - k1 - k2 - k3 AS k4
  FROM docs JOIN lined USING (doc_id)),
class_parts AS (UNPIVOT classes ON k0, k1, k2, k3, k4 INTO NAME part VALUE n),
others AS (SELECT DISTINCT lang, text, words FROM docs WHERE lang IS NULL OR lang NOT IN {tuple(lists)}),
met AS (
  SELECT lang, word, count(*) AS n FROM (
    SELECT lang, unnest(list_distinct([lower(w) FOR w IN words IF regexp_matches(w, '\p{{L}}')])) AS word FROM others)
  GROUP BY lang, word),
derived AS (
  SELECT lang, list(word) AS listed FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM met) WHERE place <= {MOST_COMMON} GROUP BY lang),
plain AS (
  SELECT doc_id, d.lang, coalesce({fixed.replace("CASE lang", "CASE d.lang")}, listed, {listed(everything)}) AS common,
         len(words) AS n_words, [lower(w) FOR w IN words] AS plain
  FROM docs d LEFT JOIN derived v ON d.lang IS NOT DISTINCT FROM v.lang),
found AS (
  SELECT doc_id, word AS part, count(*) AS n FROM (SELECT doc_id, common, unnest(plain) AS word FROM plain)
  WHERE list_contains(common, word) GROUP BY doc_id, word),
word_parts AS (
  SELECT p.doc_id, p.part, coalesce(f.n, 0) AS n
  FROM (SELECT doc_id, unnest(common) AS part FROM plain) p LEFT JOIN found f ON p.doc_id = f.doc_id AND p.part = f.part
  UNION ALL
  SELECT doc_id, '', greatest(0, n_words - coalesce((SELECT sum(n) FROM found f WHERE f.doc_id = p.doc_id), 0)) FROM plain p),
base AS (
  SELECT d.doc_id, d.lang, d.text, len(words)::bigint AS n_words, len(body)::bigint AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(words) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED_PERCENT} * len(words) AS base_failed
  FROM docs d JOIN lined USING (doc_id) LEFT JOIN repeated USING (doc_id)),
once AS (SELECT min(doc_id) AS doc_id FROM base WHERE NOT base_failed GROUP BY lang, text),
own AS (
  SELECT doc_id, lang, kind, part, n, sum(n) OVER (PARTITION BY doc_id, kind) AS own_sum
  FROM (SELECT doc_id, 'class' AS kind, part, n FROM class_parts
        UNION ALL SELECT doc_id, 'word', part, n FROM word_parts) JOIN docs USING (doc_id)),
usuals AS (
  SELECT lang, kind, part, sum(floor(n * {SHARE_UNITS} / own_sum)::bigint) AS usual
  FROM own SEMI JOIN once USING (doc_id) WHERE own_sum > 0 GROUP BY lang, kind, part),
parts AS (
  SELECT o.*, usual, sum(usual) OVER (PARTITION BY doc_id, o.kind) AS usual_sum
  FROM own o LEFT JOIN usuals u ON o.lang IS NOT DISTINCT FROM u.lang AND o.kind = u.kind AND o.part = u.part),
shares AS (SELECT *, n / own_sum AS p, usual / usual_sum AS q FROM parts WHERE own_sum > 0 AND usual_sum > 0),
distances AS (
  SELECT doc_id, kind, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance
  FROM shares GROUP BY doc_id, kind)
SELECT b.* EXCLUDE (lang, text), NOT (base_failed OR (n_words >= {CLASS_WORDS} AND coalesce(c.distance, 0) > {MOST_CLASS_DISTANCE})
            OR (n_words >= {COMMON_WORDS_NEEDED} AND coalesce(w.distance, 0) > {MOST_WORD_DISTANCE})) AS kept
FROM base b LEFT JOIN distances c ON b.doc_id = c.doc_id AND c.kind = 'class'
LEFT JOIN distances w ON b.doc_id = w.doc_id AND w.kind = 'word'
"""


ORACLES["op8_quality"] = _oracle()
