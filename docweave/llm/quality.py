"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared with those of the
whole corpus in that language by Jensen-Shannon distance; short documents are not judged by them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import bound
from docweave.llm.shared import NOT_SPACE, stored, tidy

# Common words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "für", "des", "im", "auf", "ist", "nicht", "dem", "eine", "ein", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "para", "su", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "une", "est", "pour", "qui", "dans", "par", "au", "pas", "sur", "avec"],
}
# Character classes; what belongs to none of them is a letter beyond ASCII or another sign.
CHAR_CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+", "stop": r"[.,;:'\-]+", "mark": r"[!?#*$%&|<>@~^=+_\\/(){}\[\]]+"}
SYMBOLS = r"[^#*$%&|<>]+"
REPEAT_WORDS = 8


@dataclass(frozen=True)
class Limits:
    """Base rules and the method's thresholds: distances lie in 0..1, and a histogram of fewer items is not judged."""

    min_words: int = 20
    repeat_percent: int = 30
    max_char_distance: float = 0.28
    min_chars: int = 500
    max_word_distance: float = 0.28
    min_words_judged: int = 100


def _count_of(text: Column, pattern: str) -> Column:
    """Code points of text in the runs that pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column, width: int = REPEAT_WORDS) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more in the array.

    Windows are told apart by a 64-bit hash. Only arrays with an equal pair are sorted; equal windows then stand side by side.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.sequence(F.lit(1), F.size(words) - (width - 1))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(width), at - acc["last"])).alias("n"), at.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(ordered, lambda s: F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(F.sort_array(F.transform(twice, lambda e: e["i"])))).otherwise(0)

    whole = bound(hashes, lambda hw: F.transform(windows, lambda i: F.xxhash64(F.slice(hw, i, width))))
    return F.when(F.size(words) >= width, bound(whole, of)).otherwise(0).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", extra: tuple[str, ...] = ()) -> DataFrame:
    """One slim row per document: base counts and histograms, without a shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), body.alias("_t"), *extra)
    rows = base.withColumn("_w", F.regexp_extract_all("_t", F.lit(NOT_SPACE), F.lit(0)))
    listed = reduce(lambda rest, x: F.when(F.col("lang") == x[0], F.array(*[F.lit(w) for w in x[1]])).otherwise(rest), COMMON_WORDS.items(), F.array().cast("array<string>"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(NOT_SPACE))

    def hits(w: Column) -> Column:
        found = F.lit(False)
        for name, words in COMMON_WORDS.items():
            found = found | ((F.col("lang") == name) & w.isin(words))
        return F.coalesce(found, F.lit(False))

    common = bound(F.transform(F.filter("_w", lambda w: F.length(w) <= 5), lambda w: F.lower(w)), lambda short: F.filter(short, hits))
    counts = bound(common, lambda c: F.transform(listed, lambda word: F.size(F.filter(c, lambda w: w == word)).cast("double")))
    known = [_count_of(F.col("_t"), pattern) for pattern in CHAR_CLASSES.values()]
    rows = rows.select(
        "doc_id",
        "lang",
        *extra,
        F.size("_w").cast("long").alias("n_words"),
        _count_of(F.col("_t"), NOT_SPACE).alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.length("_t").cast("double").alias("_chars"),
        F.array(*[k.cast("double") for k in known]).alias("_classes"),
        counts.alias("_common"),
    )
    return rows.withColumn("_classes", _with_rest("_classes", F.col("_chars"))).withColumn("_common", _with_rest("_common", F.col("n_words").cast("double")))


def _with_rest(counts: str, total: Column) -> Column:
    """Append what total has beyond the counts."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays of equal length; 0 where one has no counts."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def distance(np_: Column, nq: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / np_, (a / np_ + b / nq) / 2) + part(b / nq, (a / np_ + b / nq) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))

    return bound(total(p), lambda a: bound(total(q), lambda b: F.when((a > 0) & (b > 0), distance(a, b)).otherwise(F.lit(0.0))))


def judged(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add base_failed, both distances and kept to measured() rows.

    The reference of a language sums the histograms of all its documents that pass the base rules. Languages are few
    rows after pre-aggregation; a language with many documents is no hot key, since only sums travel, and the join back is
    left to Spark (broadcast below its threshold, else by hash with skewed partitions split).
    """
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    n_classes, n_common = len(CHAR_CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"_c{i}") for i in range(n_classes)] + [F.sum(F.coalesce(F.get("_common", F.lit(i)), F.lit(0.0))).alias(f"_w{i}") for i in range(n_common)]
    reference = rows.where(~F.col("base_failed")).groupBy("lang").agg(*sums).select(F.col("lang").alias("_lang"), F.array(*[f"_c{i}" for i in range(n_classes)]).alias("_ref_classes"), F.array(*[f"_w{i}" for i in range(n_common)]).alias("_ref_common"))
    reference = stored(reference, "language-references")
    rows = rows.join(reference, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    chars = F.coalesce(js_distance(F.col("_classes"), F.col("_ref_classes")), F.lit(0.0))
    # The last count is that of all other words, so a document with few common words is far from its language.
    words = F.coalesce(js_distance(F.col("_common"), F.slice("_ref_common", F.lit(1), F.size("_common"))), F.lit(0.0))
    rows = rows.withColumn("char_distance", F.when(F.col("_chars") >= limits.min_chars, chars).otherwise(0.0)).withColumn("word_distance", F.when(F.col("n_words") >= limits.min_words_judged, words).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("char_distance") <= limits.max_char_distance) & (F.col("word_distance") <= limits.max_word_distance)
    return rows.withColumn("kept", kept)


@tidy
def quality(docs: DataFrame, limits: Limits = Limits(), **columns: str) -> DataFrame:
    """Verdict per document: base counts, base_failed, char_distance, word_distance, kept.

    Null texts have no words and fail the base rules. Null or unknown languages form a language of their own, without common
    words. Repeated rows and ties are judged alike, whatever their ids; very long texts are judged whole; columns besides those
    named aren't looked at. An empty table gives no rows.
    """
    return judged(stored(measured(docs, **columns), "measured"), limits)


@tidy
def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs, as they are, that the rules keep.

    A row is measured, judged and given out where it was read: its columns lie beside its measures, so no text travels.
    """
    whole = docs.select("doc_id", "lang", "text", F.struct("*").alias("_row"))
    return quality(whole, limits, extra=("_row",)).where("kept").select("_row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    limits = Limits()
    listed = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in COMMON_WORDS.items())
    classes = ", ".join(f"(length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')))::DOUBLE" for p in CHAR_CLASSES.values())
    part = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    of = lambda p, q, n, np_, nq: f"sqrt(greatest(0, list_sum(list_transform(range(1, {n} + 1), lambda i: {part.format(a=f'({p}[i] / {np_})', b=f'({q}[i] / {nq})')} + {part.format(a=f'({q}[i] / {nq})', b=f'({p}[i] / {np_})')})) / 2))"
    distance = lambda p, q, n: f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN {of(p, q, n, f'list_sum({p})', f'list_sum({q})')} ELSE 0 END"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{NOT_SPACE}')) AS ls,
         CASE lang {listed} ELSE [] END AS common FROM documents
), windows AS (
  SELECT doc_id, i, ws[i:i + 7] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
  ) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, lang, len(ws)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '{NOT_SPACE}', '', 'g')))::BIGINT AS word_chars,
         length(regexp_replace(t, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, length(t) AS chars, [{classes}] AS cls,
         list_transform(common, lambda c: len(list_filter(ws, lambda w: length(w) <= 5 AND lower(w) = c))::DOUBLE) AS com
  FROM d LEFT JOIN twice USING (doc_id)
), m AS (
  SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed,
         list_append(cls, chars - list_sum(cls)) AS ca, list_append(com, n_words - coalesce(list_sum(com), 0)) AS wa FROM base
), ref AS (
  SELECT lang, list(c ORDER BY i) AS rc, list(w ORDER BY i) AS rw FROM (
    SELECT lang, i, sum(ca[i]) AS c, sum(coalesce(wa[i], 0)) AS w FROM m, range(1, 40) r(i) WHERE NOT base_failed GROUP BY lang, i
  ) GROUP BY lang
), far AS (
  SELECT m.*, CASE WHEN rc IS NOT NULL AND chars >= {limits.min_chars} THEN {distance('ca', f'rc[1:{len(CHAR_CLASSES) + 1}]', len(CHAR_CLASSES) + 1)} ELSE 0 END AS cd,
         CASE WHEN rw IS NOT NULL AND n_words >= {limits.min_words_judged} THEN {distance('wa', 'rw[1:len(wa)]', 'len(wa)')} ELSE 0 END AS wd
  FROM m LEFT JOIN ref ON m.lang IS NOT DISTINCT FROM ref.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND cd <= {limits.max_char_distance} AND wd <= {limits.max_word_distance} AS kept FROM far
"""


OP9_SQL = _sql()
