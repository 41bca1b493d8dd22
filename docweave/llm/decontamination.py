"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds a posting (term, document, position) for every training token that is a benchmark term. Each benchmark
window starts from the postings of its rarest term; a posting, less the term's offset in the window, is a candidate start,
and the lists of the other terms, adjusted by their offsets, must have an entry there (exact phrase) or near it (proximity). Terms have
numbers, so postings hold no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import ALNUM_WORD, ascii_lower, row_key, stored, tidy

WINDOW = 10
#: A table is broadcast only after its rows and the bytes of its texts were counted: at most so many. Beyond it, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Words that a term may stand off its place in a proximity match.
SLOP = 3
#: Stands after the last word of each document, so its position is the number of words. No word is empty, and no term has this number.
_END, _END_ID = "", -1


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _small(df: DataFrame, rows: int, text_bytes: int = 0) -> DataFrame:
    """df to be broadcast if the caller has counted few rows (of numbers, and of texts with few bytes); else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and text_bytes <= BROADCAST_BYTES else df


def benchmark_windows(items: DataFrame, width: int = WINDOW, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, owners): each different window once as (win, terms), and which items have it as (win, item).

    Items without words (null texts too) have no window. Equal items share their windows.
    """
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (width - 1)))
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, width))).alias("terms"))
    owners = stored(cut.withColumn("_sha", F.sha2(F.array_join("terms", " "), 256)).distinct(), "benchmark-owners")
    windows = stored(owners.dropDuplicates(["_sha"]).select("_sha", "terms").withColumn("win", F.monotonically_increasing_id()), "benchmark-windows")
    return windows.select("win", "terms"), owners.join(windows.select("_sha", "win"), "_sha").select("win", "item")


class Vocabulary:
    """The terms of all windows, each with a number of its own (term_id), and the end mark, stored; and their rows and bytes."""

    def __init__(self, windows: DataFrame) -> None:
        terms = windows.select(F.explode("terms").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id())
        end = windows.sparkSession.range(1).select(F.lit(_END).alias("term"), F.lit(_END_ID).cast("long").alias("term_id"))
        self.table = stored(terms.unionByName(end), "benchmark-terms")
        self.rows, self.bytes = (x or 0 for x in self.table.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first())

    def join_to(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose column is a term, with its term_id; only this table travels, if it is small."""
        return rows.join(_small(self.table, self.rows, self.bytes), F.col(column) == F.col("term")).drop("term", column)


def _tokens(docs: DataFrame, doc_id: str, text: str, end: bool = False) -> DataFrame:
    found = words(F.col(text))
    found = F.array_append(found, F.lit(_END)) if end else found
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("_key"), F.posexplode(found).alias("pos", "word"))


def positional_index(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths), stored in the shared folder: (term_id, doc_id, _key, pos) of the vocabulary's terms, and (doc_id, _key, n_words) of every row.

    Both come from one pass over the texts.
    """
    index = stored(vocabulary.join_to(_tokens(docs, doc_id, text, end=True), "word").select("term_id", "doc_id", "_key", "pos"), "positional-index")
    ends = index.where(F.col("term_id") == _END_ID).select("doc_id", "_key", F.col("pos").cast("long").alias("n_words"))
    return index.where(F.col("term_id") != _END_ID), stored(ends, "text-lengths")


def matches(docs: DataFrame, index: DataFrame, windows: DataFrame, vocabulary: Vocabulary, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of windows (win, terms): doc_id, _key, win, start, n (words), exact (every term in place).

    Without exact, every term but the rarest stands within ``slop`` words of its place. Windows with a term that no document has are left
    out first. Each other one starts from the postings of its rarest term, which are intersected with those of its
    second rarest; only the few starts that remain meet all words of their documents.
    """
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))  # a row for each term
    terms = vocabulary.join_to(windows.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "word")), "word")
    terms = stored(terms.join(_small(counts, vocabulary.rows), "term_id", "left"), "window-terms")
    place = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term_id")
    ranked = terms.groupBy("win", "n").agg(F.array_sort(F.collect_list(place)).alias("by_df"))  # at most n terms each
    first, second = F.get("by_df", F.lit(0)), F.get("by_df", F.least(F.size("by_df") - 1, F.lit(1)))
    leads = stored(ranked.where(first["df"] > 0).select("win", "n", first["term_id"].alias("term_id"), first["off"].alias("off"), second["term_id"].alias("term2"), second["off"].alias("off2")), "leads")
    n_leads = leads.count()
    width = 2 * slop + 1

    def expected(rows: DataFrame) -> DataFrame:
        """One row for each cell of positions in which the term may stand."""
        cells = F.array_distinct(F.array(F.floor((F.col("at") - slop) / width), F.floor((F.col("at") + slop) / width)))
        return rows.withColumn("cell", F.explode(cells))

    def met(rows: DataFrame, postings: DataFrame) -> DataFrame:
        """Rows (term_id, doc_id, _key, at, cell, ...) with the postings of the term within slop of at."""
        p = postings.select(F.col("term_id").alias("_term"), F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"), "pos", F.floor(F.col("pos") / width).alias("_cell"))
        same = (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("term_id") == F.col("_term")) & (F.col("cell") == F.col("_cell"))
        return rows.join(p, same).where(F.abs(F.col("pos") - F.col("at")) <= slop)

    starts = index.join(_small(leads, n_leads), "term_id").select("doc_id", "_key", "win", "n", F.col("term2").alias("term_id"), "off2", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= -slop)
    seconds = index.join(_small(leads.select(F.col("term2").alias("term_id")).distinct(), n_leads), "term_id", "left_semi")
    both = met(expected(starts.withColumn("at", F.col("start") + F.col("off2"))), seconds)
    starts = stored(both.select("doc_id", "_key", "win", "n", "start").distinct(), "starts")
    # The words of the documents with starts come from their texts, which are less than the postings of all documents.
    seen = stored(starts.select(F.col("doc_id").alias("_seen"), F.col("_key").alias("_seen_key")).distinct(), "candidate-documents")
    of = docs.join(_small(seen, seen.count()), F.col(doc_id).eqNullSafe(F.col("_seen")) & (row_key(F.col(doc_id), F.col(text)) == F.col("_seen_key")), "left_semi")
    near = vocabulary.join_to(_tokens(of, doc_id, text), "word")
    places = starts.join(_small(terms.select("win", "off", "term_id"), n_leads * WINDOW), "win").withColumn("at", F.col("start") + F.col("off"))
    found = met(expected(places), near)
    each = found.groupBy("doc_id", "_key", "win", "n", "start", "off").agg(F.max((F.col("pos") == F.col("at")).cast("int")).alias("here"))
    whole = each.groupBy("doc_id", "_key", "win", "n", "start").agg(F.count(F.lit(1)).alias("got"), F.sum("here").alias("here"))
    return whole.where("got = n").select("doc_id", "_key", "win", "start", "n", (F.col("here") == F.col("n")).alias("exact"))


def _hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, width: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(hits, lengths): n_hit, n_items, _items, n_near of each document with matches, and the words of every row."""
    windows, owners = benchmark_windows(items, width)
    vocabulary = Vocabulary(windows)
    index, lengths = positional_index(docs, vocabulary, doc_id, text)
    found = stored(matches(docs, index, windows, vocabulary, slop, doc_id, text).distinct(), "matches")
    exact = found.where("exact")
    keys = ["doc_id", "_key"]
    hit = exact.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    of = exact.join(owners, "win").select(*keys, "item").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("_items"))
    near = found.where("not exact").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_near"))
    return stored(_outer(_outer(hit, of, keys), near, keys), "hits"), lengths


@tidy
def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document row: doc_id, _key, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts proximity matches: starts at which a window's rarest term (the first of equally rare ones) stands in place and every
    other term within ``slop`` words of its place, but not all in place. Null and empty texts have no words; very long texts are indexed whole;
    repeated rows have equal results, and ids may be null; items with one text share their windows, and all of them are named; other
    columns aren't looked at. An empty benchmark hits nothing, and an empty table of documents gives no rows.
    """
    result, rows = _hits(docs, items, doc_id, text, width, slop)
    both = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_key"] == b["_key"])
    out = rows.join(result, both(rows, result), "left").select(
        rows["doc_id"],
        rows["_key"],
        "n_words",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")],
        F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    return out


def _outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both, null-safe: missing columns are filled by one more aggregation instead of a full outer join."""
    rest = [c for c in (*a.columns, *b.columns) if c not in keys]
    wide = lambda x: x.select(*keys, *[(F.col(c) if c in x.columns else F.lit(None)).alias(c) for c in rest])
    return wide(a).unionByName(wide(b)).groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


@tidy
def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs.

    Few documents with hits travel to the texts; beyond BROADCAST_ROWS of them, the texts are shuffled.
    """
    dirty = _hits(docs, items, doc_id, text, WINDOW, SLOP)[0].where("n_hit > 0").select(F.col("doc_id").alias("__leak_id"), F.col("_key").alias("__leak_key"))
    return docs.join(_small(dirty, dirty.count()), F.col(doc_id).eqNullSafe(F.col("__leak_id")) & (row_key(F.col(doc_id), F.col(text)) == F.col("__leak_key")), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("_key")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)
),
grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))
),
found AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.x = win.x),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
toks AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM dw),
freq AS (SELECT term, count(*) AS df FROM toks GROUP BY term),
offs AS (SELECT x, n, unnest(x) AS term, unnest(range(0, n)) AS off FROM (SELECT DISTINCT n, x FROM win)),
lead AS (SELECT x, n, off, term FROM (
  SELECT x, n, off, offs.term, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY x ORDER BY coalesce(df, 0), off) AS r FROM offs LEFT JOIN freq ON offs.term = freq.term
) WHERE r = 1 AND df > 0),
begun AS (SELECT toks.doc_id, x, n, pos - off AS s FROM toks JOIN lead ON toks.term = lead.term WHERE pos - off >= -3),
close AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT begun.*, w FROM begun JOIN dw ON begun.doc_id IS NOT DISTINCT FROM dw.doc_id)
  WHERE len(list_filter(range(0, n), lambda o: NOT list_contains(w[greatest(1, s + o - 2):s + o + 4], x[o + 1]))) = 0 AND NOT (s >= 0 AND w[s + 1:s + n] = x)
  GROUP BY doc_id
),
of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id) LEFT JOIN close USING (doc_id)
"""
