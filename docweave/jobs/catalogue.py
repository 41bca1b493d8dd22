"""Registered queries by name, and the SQL that gives the same rows.

The SQL is written for DuckDB and apart from the Spark expressions: joins, window functions and list lookups where Spark folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import llm_api, paths
from docweave.functions.text import SENTENCE_ENDS, WHITE, bound, escape_html, filled_lines, lines, mask, preview, splitlines, strip, tokens, uri_component
from docweave.jobs.convert import convert, convert_by_rows, summary
from docweave.jobs.uploads import replies
from docweave.operators.label import LABELERS, blocks, by_model, labelled, markdown, mod, rejected, rule
from docweave.operators.merge import merged, merged_rows, search_depth, shared_lines
from docweave.operators.segment import MAX_TOKENS, OVERLAP_TOKENS, chunks, hard_split, paragraphs, sentences
from docweave.sources.labels import label_once, stored_labels
from docweave.sources.scratch import scratch
from docweave.sources.sink import publish
from docweave.streaming import landing

#: Limits at which every branch of the splitter runs on small data.
SMALL = (200, 20)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")


def exploded(df: DataFrame, key: str, values: Column, index: str, value: str) -> DataFrame:
    return df.select(key, F.posexplode(values).alias(index, value)).withColumn(index, F.col(index).cast("long"))


def if_any(docs: DataFrame, values: Column, of) -> DataFrame:
    """(doc_id, fields of of(values)) where the array has elements; a generator computes it once, a filter would do so again."""
    rows = bound(values, lambda v: F.when(F.size(v) > 0, F.array(of(v))).otherwise(F.slice(F.array(of(v)), F.lit(1), F.lit(0))))
    return docs.select("doc_id", F.inline(rows))


# Fragments of SQL.
_W = "'" + WHITE + "'"
_STRIP = lambda x: f"trim({x}, {_W})"
_BLANK = lambda x: f"length(trim({x}, {_W})) = 0"
_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_NUMBERED = lambda source, key, index, value: f"SELECT {key}, (unnest(range(1, len(a) + 1)) - 1)::BIGINT AS {index}, unnest(a) AS {value} FROM ({source})"
_SENTENCES = lambda t: f"list_filter(regexp_extract_all({t}, '([^。？！.!?\n]*[。？！.!?\n]+|[^。？！.!?\n]+)', 1), lambda s: NOT ({_BLANK('s')}))"
_FILLED = lambda t: f"list_filter(list_transform(string_split({_STRIP(t)}, chr(10)), lambda l: {_STRIP('l')}), lambda l: length(l) > 0)"
_LABEL = {
    "rule": lambda l: f"CASE WHEN right({l}, 1) IN ('。','？','！','.','!','?',chr(10)) THEN 'P' WHEN length({l}) <= 20 THEN 'H1' WHEN length({l}) <= 40 THEN 'H2' WHEN length({l}) <= 60 THEN 'H3' WHEN length({l}) <= 80 THEN 'H4' ELSE 'P' END",
    "mod": lambda l: f"CASE length({l}) % 6 WHEN 0 THEN 'H1' WHEN 1 THEN 'H2' WHEN 2 THEN 'H3' WHEN 3 THEN 'H4' WHEN 4 THEN 'P' END",
}
_LABELLED = lambda t, how="rule": f"array_to_string(list_transform({_FILLED(t)}, lambda l: coalesce(({_LABEL[how]('l')}) || ': ', '') || l), chr(10))"
_BLOCK = lambda l: f"CASE WHEN {l}[1:4] = 'H1: ' THEN '# ' || {l}[5:] WHEN {l}[1:4] = 'H2: ' THEN '## ' || {l}[5:] WHEN {l}[1:4] = 'H3: ' THEN '### ' || {l}[5:] WHEN {l}[1:4] = 'H4: ' THEN '#### ' || {l}[5:] WHEN {l}[1:3] = 'P: ' THEN {l}[4:] END"
_BLOCKS = lambda t: f"list_filter(list_transform({_FILLED(t)}, lambda l: {_BLOCK('l')}), lambda b: b IS NOT NULL)"
_MARKDOWN = lambda t: _STRIP(f"array_to_string({_BLOCKS(t)}, chr(10) || chr(10))")
_SPLITLINES = lambda t: f"list_transform([string_split_regex({t}, {_ENDS})], lambda p: CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END)[1]"


def _hard(t: str, width: int, shared: int) -> str:
    """Windows in closed form (the driver's tables have no blank window)."""
    step = width - shared
    return f"list_transform(range(0, CASE WHEN length({t}) <= {width} THEN 1 ELSE CAST(ceil((length({t}) - {width}) / {step}.0) AS BIGINT) + 1 END), lambda i: substr({t}, i * {step} + 1, {width}))"


def _chunks_sql(max_tokens: int, overlap: int) -> str:
    """CTEs up to packed(doc_id, a). The texts have no blank lines, so a text is one paragraph; carried segments come from suffix sums."""
    width, shared, tail = 2 * max_tokens, 2 * overlap, int(overlap * 1.6)
    segs = f"CASE WHEN length({_STRIP('text')}) // 2 > {max_tokens} THEN {_SENTENCES('text')} WHEN {_BLANK('text')} THEN [] ELSE [text] END"
    joined = "array_to_string(a.buf, '')"
    sizes = "list_transform(a.buf, lambda z: (length(z) // 2)::BIGINT)"
    first = f"coalesce(list_min(list_filter(range(1, len(a.buf) + 1), lambda i: list_sum(({sizes})[i:]) <= {overlap} * 1.1)), len(a.buf))"
    carry = f"array_to_string(a.buf[{first}:], '')"
    cast = "STRUCT(chunks VARCHAR[], buf VARCHAR[], tok BIGINT, s VARCHAR)"
    row = lambda chunks, buf, tok: f"{{'chunks': {chunks}, 'buf': {buf}, 'tok': ({tok})::BIGINT, 's': ''}}::{cast}"
    pieces = _hard("x.s", width, shared)
    last = f"({pieces})[-1]"
    big = f"CASE WHEN {overlap} > 0 AND length({last}) > {tail} AND NOT ({_BLANK(f'right({last}, {tail})')}) THEN {row(f'list_concat(a.chunks, CASE WHEN len(a.buf) > 0 THEN [{joined}] ELSE [] END, {pieces})', f'[right({last}, {tail})]', f'{tail} // 2')} ELSE {row(f'list_concat(a.chunks, CASE WHEN len(a.buf) > 0 THEN [{joined}] ELSE [] END, {pieces})', '[]::VARCHAR[]', '0')} END"
    if overlap > 0:
        over = f"CASE WHEN length({carry}) // 2 > 0 AND length({carry}) // 2 + length(x.s) // 2 > {max_tokens} THEN {row(f'list_concat(a.chunks, [{joined}, {carry}])', '[x.s]', 'length(x.s) // 2')} ELSE {row(f'list_concat(a.chunks, [{joined}])', f'[{carry}, x.s]', f'length({carry}) // 2 + length(x.s) // 2')} END"
    else:
        over = row(f"list_concat(a.chunks, [{joined}])", "[x.s]", "length(x.s) // 2")
    fold = f"CASE WHEN length(x.s) // 2 > {max_tokens} THEN {big} WHEN len(a.buf) = 0 OR a.tok + length(x.s) // 2 <= {max_tokens} THEN {row('a.chunks', 'list_append(a.buf, x.s)', 'a.tok + length(x.s) // 2')} ELSE {over} END"
    start = row("[]::VARCHAR[]", "[]::VARCHAR[]", "0")
    return f"""
WITH segs AS (SELECT doc_id, {segs} AS s FROM documents WHERE text IS NOT NULL),
folded AS (
  SELECT doc_id, list_reduce(list_prepend({start}, list_transform(s, lambda z: {{'chunks': []::VARCHAR[], 'buf': []::VARCHAR[], 'tok': 0::BIGINT, 's': z}}::{cast})), lambda a, x: {fold}) AS f FROM segs
),
packed AS (SELECT doc_id, list_filter(list_concat(f.chunks, CASE WHEN len(f.buf) > 0 THEN [array_to_string(f.buf, '')] ELSE [] END), lambda c: NOT ({_BLANK('c')})) AS a FROM folded)
"""


_SMALL = _chunks_sql(*SMALL)
_CHUNKS = _SMALL + ", chunks AS (" + _NUMBERED("SELECT doc_id, a FROM packed", "doc_id", "chunk_ix", "chunk") + ")"


@query("token_estimate", "SELECT doc_id, (coalesce(length(text), 0) // 2)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("n_tokens"))


@query("long_documents", f"SELECT doc_id, (length(text) // 2)::BIGINT AS n_tokens FROM documents WHERE length(text) // 2 > {MAX_TOKENS}")
def long_documents(spark, sf_dir):
    """By the text alone: n_chars may be missing or stale."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", tokens(F.col("text")).alias("n_tokens")).where(F.col("n_tokens") > MAX_TOKENS)


@query("route", f"SELECT doc_id, CASE WHEN coalesce(length(text), 0) // 2 <= {MAX_TOKENS} THEN 'direct' ELSE 'chunked' END AS route FROM documents")
def route(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.when(tokens(F.col("text")) <= MAX_TOKENS, "direct").otherwise("chunked").alias("route"))


_PATHS = "SELECT doc_id, '/in/' || source || '/' || doc_id || (['.docx', '.PDF', '.txt', '', '.tar.pdf'])[doc_id % 5 + 1] AS path, doc_id % 5 AS k FROM documents"


def named(spark, sf_dir) -> DataFrame:
    """Documents with the path of a file of one of five extensions."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".docx", ".PDF", ".txt", "", ".tar.pdf")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).withColumn("path", F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext))


@query("file_type", f"SELECT doc_id, CASE k WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 4 THEN 'pdf' ELSE 'unsupported' END AS file_type FROM ({_PATHS})")
def file_type(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", paths.file_type(F.col("path")).alias("file_type"))


@query("supported_files", f"SELECT doc_id, path FROM ({_PATHS}) WHERE k IN (0, 1, 4)")
def supported_files(spark, sf_dir):
    return named(spark, sf_dir).where(paths.file_type(F.col("path")) != "unsupported").select("doc_id", "path")


@query("output_name", f"SELECT doc_id, doc_id || CASE k WHEN 4 THEN '.tar' ELSE '' END || '.md' AS out_path FROM ({_PATHS})")
def output_name(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", paths.result_name(F.col("path")).alias("out_path"))


@query("output_collisions", "SELECT (doc_id // 2) || '.md' AS out_path, count(*)::BIGINT AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def output_collisions(spark, sf_dir):
    """Results that several inputs would write: 7.docx and 7.pdf both become 7.md."""
    ext = F.when(F.col("doc_id") % 2 == 0, ".docx").otherwise(".pdf")
    path = F.concat(F.lit("/in/"), F.floor(F.col("doc_id") / 2).cast("string"), ext)
    return documents(spark, sf_dir).groupBy(paths.result_name(path).alias("out_path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("web_allowed", f"SELECT doc_id, k IN (0, 1, 4) AS allowed FROM ({_PATHS})")
def web_allowed(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", paths.upload_allowed(paths.base_name(F.col("path"))).alias("allowed"))


@query("size_cap", "SELECT doc_id FROM documents WHERE strlen(text) <= 33554432")
def size_cap(spark, sf_dir):
    return documents(spark, sf_dir).where(F.octet_length("text") <= 32 << 20).select("doc_id")


@query(
    "paragraphs",
    f"""WITH conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
parts AS (SELECT conv_id, string_split_regex(regexp_replace(t, '^\n{{2,}}', ''), '\n{{2,}}') AS p, regexp_extract_all(regexp_replace(t, '^\n{{2,}}', ''), '\n{{2,}}') AS e FROM conv),
glued AS (SELECT conv_id, list_filter(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(e[i], '')), lambda s: NOT ({_BLANK('s')})) AS a FROM parts)
""" + _NUMBERED("SELECT conv_id, a FROM glued", "conv_id", "seg_ix", "seg"),
)
def paragraph_rows(spark, sf_dir):
    """Turns of a conversation are joined by blank lines, then cut into paragraphs again."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n")
    return exploded(turns.withColumn("t", text), "conv_id", F.filter(paragraphs(F.col("t")), lambda s: ~(F.length(F.btrim(s, F.lit(WHITE))) == 0)), "seg_ix", "seg")


@query("sentences", _NUMBERED(f"SELECT doc_id, {_SENTENCES('text')} AS a FROM documents", "doc_id", "sent_ix", "sent"))
def sentence_rows(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", sentences(F.col("text")), "sent_ix", "sent")


@query("hard_split", _NUMBERED(f"SELECT doc_id, {_hard('text', 400, 80)} AS a FROM documents WHERE NOT ({_BLANK('text')})", "doc_id", "ix", "piece"))
def hard_split_rows(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", hard_split(F.col("text"), 200, 40), "ix", "piece")


@query("lines", _NUMBERED(f"SELECT doc_id, string_split({_STRIP('text')}, chr(10)) AS a FROM documents", "doc_id", "line_ix", "line"))
def line_rows(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", lines(F.col("text")), "line_ix", "line")


@query("splitlines", _NUMBERED(f"SELECT doc_id, {_SPLITLINES('text')} AS a FROM documents", "doc_id", "line_ix", "line"))
def splitlines_rows(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", splitlines(F.col("text")), "line_ix", "line")


@query("chunks_small", _CHUNKS + "SELECT * FROM chunks")
def chunks_small(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", chunks(F.col("text"), *SMALL), "chunk_ix", "chunk")


@query("chunks_default", _chunks_sql(MAX_TOKENS, OVERLAP_TOKENS) + _NUMBERED("SELECT doc_id, a FROM packed", "doc_id", "chunk_ix", "chunk"))
def chunks_default(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", chunks(F.col("text")), "chunk_ix", "chunk")


@query("chunk_stats", _CHUNKS + "SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(length(chunk) // 2)::BIGINT AS n_tokens, max(length(chunk) // 2)::BIGINT AS max_tokens FROM chunks GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    def of(n: Column) -> Column:
        return F.struct(F.size(n).cast("long").alias("n_chunks"), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), F.array_max(n).alias("max_tokens"))

    return if_any(documents(spark, sf_dir), F.transform(chunks(F.col("text"), *SMALL), tokens), of)


@query("duplicate_chunks", _CHUNKS + "SELECT doc_id, count(*) FILTER (before IS NOT NULL AND suffix(before, chunk))::BIGINT AS n_dup FROM (SELECT doc_id, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_ix) AS before FROM chunks) GROUP BY doc_id")
def duplicate_chunks(spark, sf_dir):
    def of(c: Column) -> Column:
        again = F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1).endswith(x), F.lit(False)))
        return F.struct(F.size(again).cast("long").alias("n_dup"))

    return if_any(documents(spark, sf_dir), chunks(F.col("text"), *SMALL), of)


def label_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, labeler, line_ix, label, content) of the filled lines, for each labeler."""

    def by(labeler):
        return F.transform(filled_lines(F.col("text")), lambda s: F.struct(labeler(s).alias("label"), s.alias("content")))

    each = F.array(*[F.struct(F.lit(name).alias("labeler"), by(f).alias("rows")) for name, f in LABELERS.items()])
    rows = docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.labeler", F.posexplode("x.rows").alias("line_ix", "r"))
    return rows.select("doc_id", "labeler", F.col("line_ix").cast("long").alias("line_ix"), "r.label", "r.content")


_FILLED_ROWS = _NUMBERED(f"SELECT doc_id, {_FILLED('text')} AS a FROM documents", "doc_id", "line_ix", "content")
_LABEL_ROWS = f"SELECT doc_id, 'rule' AS labeler, line_ix, {_LABEL['rule']('content')} AS label, content FROM f UNION ALL SELECT doc_id, 'mod', line_ix, {_LABEL['mod']('content')}, content FROM f"


@query("label_lines", f"WITH f AS ({_FILLED_ROWS}) {_LABEL_ROWS}")
def label_lines(spark, sf_dir):
    return label_rows(documents(spark, sf_dir))


@query("label_counts", f"WITH f AS ({_FILLED_ROWS}), l AS ({_LABEL_ROWS}) SELECT labeler, label, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def label_counts(spark, sf_dir):
    return label_rows(documents(spark, sf_dir)).groupBy("labeler", "label").agg(F.count(F.lit(1)).alias("n"))


@query("markdown_blocks", f"WITH m AS (SELECT doc_id, {_BLOCKS(_LABELLED('text', 'mod'))} AS a FROM documents) " + _NUMBERED("SELECT doc_id, a FROM m", "doc_id", "block_ix", "block"))
def markdown_blocks(spark, sf_dir):
    return exploded(documents(spark, sf_dir), "doc_id", blocks(labelled(F.col("text"), mod)), "block_ix", "block")


@query("markdown_docs", f"SELECT doc_id, {_MARKDOWN(_LABELLED('text'))} AS markdown FROM documents")
def markdown_docs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", markdown(labelled(F.col("text"))).alias("markdown"))


@query("rejected_lines", f"SELECT doc_id, len(list_filter({_FILLED('text')}, lambda l: length(l) % 6 = 5))::BIGINT AS n_rejected FROM documents")
def rejected_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rejected(labelled(F.col("text"), mod)).alias("n_rejected"))


_HTML_BLOCK = r"<(h[1-4]|p)>([^<]*)"


@query(
    "html_to_markdown",
    f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_HTML_BLOCK}', 1) AS tags, regexp_extract_all(html, '{_HTML_BLOCK}', 2) AS texts FROM pages),
l AS (SELECT page_id, list_filter(list_transform(range(1, len(tags) + 1), lambda i: [upper(tags[i]), {_STRIP('texts[i]')}]), lambda r: length(r[2]) > 0) AS rows FROM x)
SELECT page_id, {_STRIP("array_to_string(list_transform(rows, lambda r: CASE r[1] WHEN 'H1' THEN '# ' WHEN 'H2' THEN '## ' WHEN 'H3' THEN '### ' WHEN 'H4' THEN '#### ' ELSE '' END || r[2]), chr(10) || chr(10))")} AS markdown FROM l""",
)
def html_to_markdown(spark, sf_dir):
    """Headings and paragraphs of a page become labelled lines, then Markdown.

    The SQL ends a block's text at its first inline tag and has no block with attributes, so it gives less than this.
    """
    return table(spark, sf_dir, "pages").select("page_id", markdown(F.array_join(html_lines(F.col("html")), "\n")).alias("markdown"))


_TAG_REST = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_NO_TEXT = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title){_TAG_REST}.*?(?:</\1\s*>|\z)"
_ENDS_P = "address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
_WHOLE_BLOCK = rf"(?is)<(h[1-4]{_TAG_REST}.*?(?=</?(?:h[1-6]|p)(?=[\s/>])|\z)|p{_TAG_REST}.*?(?=</?(?:{_ENDS_P})(?=[\s/>])|\z))"


def html_lines(html: Column) -> Column:
    """A labelled line for each heading (up to its end tag or the next block) and paragraph (up to any tag of a block), without inline tags."""

    def line(found: Column) -> Column:
        text = F.regexp_replace(found, rf"(?is)^(?:h[1-4]|p){_TAG_REST}", "")
        text = F.regexp_replace(text, rf"(?i)</?(?:br|{_ENDS_P}){_TAG_REST}", " ")
        text = F.regexp_replace(text, rf"</?[a-zA-Z][^\s/>]*+{_TAG_REST}|<[!?][^>]*>", "")
        return F.concat(F.upper(F.regexp_extract(found, "(?i)^(h[1-4]|p)", 1)), F.lit(": "), F.btrim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), F.lit(WHITE)))

    return F.transform(F.regexp_extract_all(F.regexp_replace(html, _NO_TEXT, " "), F.lit(_WHOLE_BLOCK), F.lit(1)), line)


def _fold_sql(rows: str) -> str:
    """CTEs that add chunks one by one from labelled(doc_id, chunk_ix, n, t) by recursion, up to done(doc_id, m)."""
    depth = search_depth(SMALL[1])
    tail = f"list_transform(m[greatest(len(m) - {depth} + 1, 1):], lambda l: {_STRIP('l')})"
    head = f"list_transform(c[1:{depth}], lambda l: {_STRIP('l')})"
    return f"""{rows},
split AS (SELECT doc_id, chunk_ix, n, t, {_SPLITLINES('t')} AS c FROM labelled),
steps AS (
  SELECT doc_id, chunk_ix, n, c AS m FROM split WHERE chunk_ix = 0
  UNION ALL
  SELECT doc_id, chunk_ix, n, CASE WHEN {_BLANK('t')} OR len(c) = 0 THEN m WHEN len(m) = 0 THEN c WHEN k > 0 THEN list_concat(m, c[k + 1:])
    WHEN NOT ({_BLANK('m[len(m)]')}) AND NOT ({_BLANK('c[1]')}) THEN list_concat(m, [''], c) ELSE list_concat(m, c) END
  FROM (
    SELECT s.doc_id, x.chunk_ix, s.n, s.m, x.c, x.t, coalesce((SELECT max(k) FROM range(1, {depth} + 1) r(k)
      WHERE k <= len(s.m) AND k <= len(x.c) AND list_transform(s.m[len(s.m) - k + 1:], lambda l: {_STRIP('l')}) = list_transform(x.c[1:k], lambda l: {_STRIP('l')})
        AND (k = 1 OR len(list_filter(x.c[1:k], lambda l: length({_STRIP('l')}) > 3)) > 0)), 0) AS k
    FROM steps s JOIN split x ON x.doc_id = s.doc_id AND x.chunk_ix = s.chunk_ix + 1
  )
),
joined AS (SELECT doc_id, n, {_STRIP("array_to_string(m, chr(10))")} AS j FROM steps WHERE chunk_ix = n - 1),
done AS (SELECT doc_id, CASE WHEN n > 1 AND length(j) > 0 THEN j || chr(10) ELSE j END AS m FROM joined)
"""


_RECURSIVE = _SMALL.replace("WITH segs", "WITH RECURSIVE segs", 1) + ", chunks AS (" + _NUMBERED("SELECT doc_id, a FROM packed", "doc_id", "chunk_ix", "chunk") + ")"
_LABELLED_CHUNKS = f", labelled AS (SELECT doc_id, chunk_ix, count(*) OVER (PARTITION BY doc_id) AS n, {_LABELLED('chunk')} AS t FROM chunks)"


def labelled_parts() -> Column:
    return F.transform(chunks(F.col("text"), *SMALL), lambda c: labelled(c, rule))


@query(
    "overlap_rows",
    _CHUNKS + f""", l AS (SELECT doc_id, chunk_ix, {_SPLITLINES(_LABELLED('chunk'))} AS c FROM chunks)
SELECT b.doc_id, b.chunk_ix, coalesce((SELECT max(k) FROM range(1, {search_depth(SMALL[1])} + 1) r(k) WHERE k <= len(a.c) AND k <= len(b.c)
  AND list_transform(a.c[len(a.c) - k + 1:], lambda l: {_STRIP('l')}) = list_transform(b.c[1:k], lambda l: {_STRIP('l')})
  AND (k = 1 OR len(list_filter(b.c[1:k], lambda l: length({_STRIP('l')}) > 3)) > 0)), 0)::BIGINT AS k
FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.chunk_ix = a.chunk_ix + 1""",
)
def overlap_rows(spark, sf_dir):
    """Lines that neighbouring labelled chunks share."""
    def pairs(c: Column) -> Column:
        later = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
        return F.transform(later, lambda after, i: shared_lines(F.get(c, i), after, search_depth(SMALL[1])))

    out = documents(spark, sf_dir).select("doc_id", F.posexplode(bound(F.transform(labelled_parts(), splitlines), pairs)).alias("i", "k"))
    return out.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk_ix"), F.col("k").cast("long").alias("k"))


@query("merged_labels", _fold_sql(_RECURSIVE + _LABELLED_CHUNKS) + "SELECT doc_id, m AS labelled FROM done")
def merged_labels(spark, sf_dir):
    return if_any(documents(spark, sf_dir), labelled_parts(), lambda p: F.struct(merged(p, SMALL[1]).alias("labelled")))


@query("merged_by_rows", ORACLES["merged_labels"])
def merged_by_rows(spark, sf_dir):
    """The same from rows: each chunk adds its lines, and a document's are joined at the end."""
    rows = exploded(documents(spark, sf_dir), "doc_id", labelled_parts(), "chunk_ix", "labelled")
    each = merged_rows(rows, overlap=SMALL[1]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "lines"))).alias("_parts"))
    text = strip(F.array_join(F.flatten(F.transform("_parts", lambda p: p["lines"])), "\n"))
    many = (F.size("_parts") > 1) & (F.length(text) > 0)
    return each.select("doc_id", F.when(many, F.concat(text, F.lit("\n"))).otherwise(text).alias("labelled"))


_STAGE = lambda md: f"CASE WHEN length({md}) = 0 THEN 'format' END"


@query(
    "pipeline_direct",
    f"WITH m AS (SELECT doc_id, {_MARKDOWN(_LABELLED('text', 'mod'))} AS md FROM documents WHERE length(text) // 2 <= {MAX_TOKENS}) SELECT doc_id, CASE WHEN length(md) > 0 THEN md END AS markdown, {_STAGE('md')} AS error_stage FROM m",
)
def pipeline_direct(spark, sf_dir):
    """The short documents, labelled as they are."""
    return convert(documents(spark, sf_dir).where(tokens(F.col("text")) <= MAX_TOKENS), labeler=mod).select("doc_id", "markdown", "error_stage")


_CONVERTED = (
    _fold_sql(_RECURSIVE + _LABELLED_CHUNKS)
    + f""", direct AS (SELECT doc_id, {_MARKDOWN(_LABELLED('text'))} AS md FROM documents WHERE length(text) // 2 <= {SMALL[0]}),
long AS (SELECT doc_id, m, {_MARKDOWN('m')} AS md FROM documents JOIN done USING (doc_id) WHERE length(text) // 2 > {SMALL[0]}),
converted AS (
  SELECT doc_id, CASE WHEN length(md) > 0 THEN md END AS markdown, {_STAGE('md')} AS error_stage FROM direct
  UNION ALL SELECT doc_id, CASE WHEN length(md) > 0 AND NOT ({_BLANK('m')}) THEN md END, CASE WHEN {_BLANK('m')} THEN 'merge' ELSE {_STAGE('md')} END FROM long
)
"""
)


@query("pipeline_chunked", _CONVERTED + "SELECT doc_id, markdown, error_stage FROM converted")
def pipeline_chunked(spark, sf_dir):
    """All documents at small limits: most are split, labelled by chunk and merged."""
    return convert(documents(spark, sf_dir), max_tokens=SMALL[0], overlap=SMALL[1]).select("doc_id", "markdown", "error_stage")


@query(
    "pipeline_by_rows",
    _CONVERTED + """, failing AS (SELECT DISTINCT doc_id FROM chunks WHERE chunk_ix % 7 = 6)
SELECT c.doc_id, CASE WHEN f.doc_id IS NULL THEN markdown END AS markdown, CASE WHEN f.doc_id IS NULL THEN error_stage ELSE 'label' END AS error_stage
FROM converted c LEFT JOIN failing f ON c.doc_id = f.doc_id""",
)
def pipeline_by_rows(spark, sf_dir):
    """The conversion as with a service: chunks as rows, labelled in any order, one failed chunk (every seventh here) fails its document."""

    def label(rows: DataFrame) -> DataFrame:
        good = F.col("chunk_ix") % 7 != 6
        return rows.repartition(F.xxhash64("chunk")).select("doc_id", "chunk_ix", F.when(good, labelled(F.col("chunk"), rule)).alias("labelled"), F.when(~good, F.lit("refused")).alias("error"))

    return convert_by_rows(documents(spark, sf_dir), label, max_tokens=SMALL[0], overlap=SMALL[1]).select("doc_id", "markdown", "error_stage")


def rule_model():
    """A stand-in for a model: the rule on lines, applied to lists of texts."""
    heads = ((20, "H1"), (40, "H2"), (60, "H3"), (80, "H4"))

    def kind(line: str) -> str:
        return "P" if line[-1] in SENTENCE_ENDS else next((name for most, name in heads if len(line) <= most), "P")

    return lambda texts: ["\n".join(f"{kind(s)}: {s}" for s in (line.strip(WHITE) for line in text.strip(WHITE).split("\n")) if s) for text in texts]


@query("pipeline_by_model", ORACLES["pipeline_chunked"])
def pipeline_by_model(spark, sf_dir):
    """The conversion with a model in the tasks, loaded once in each worker."""
    return convert_by_rows(documents(spark, sf_dir), by_model(rule_model), max_tokens=SMALL[0], overlap=SMALL[1]).select("doc_id", "markdown", "error_stage")


@query("order_restore", _SMALL + "SELECT doc_id, array_to_string(a, '') AS joined FROM packed WHERE len(a) > 0")
def order_restore(spark, sf_dir):
    """Chunks come back in any order and are sorted by their number."""
    rows = chunks_small(spark, sf_dir).repartition(F.xxhash64("chunk"))
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda p: p["chunk"]), "").alias("joined"))


_FAIL = _CHUNKS + ", f AS (SELECT doc_id, NOT bool_or(chunk_ix % 7 = 6) AS ok FROM chunks GROUP BY doc_id) "


@query("fail_fast", _FAIL + "SELECT doc_id, ok FROM f")
def fail_fast(spark, sf_dir):
    """A document fails with any of its chunks; every seventh has no label here."""
    answers = chunks_small(spark, sf_dir).select("doc_id", F.when(F.col("chunk_ix") % 7 != 6, labelled(F.col("chunk"))).alias("labelled"))
    return answers.groupBy("doc_id").agg((~F.bool_or(F.col("labelled").isNull())).alias("ok"))


@query("run_summary", _FAIL + "SELECT count(*) FILTER (ok)::BIGINT AS processed, count(*) FILTER (NOT ok)::BIGINT AS errors, CASE WHEN bool_and(ok) THEN 0 ELSE 1 END::BIGINT AS exit_code FROM f")
def run_summary(spark, sf_dir):
    return summary(fail_fast(spark, sf_dir))


@query("request_payload", f"SELECT doc_id, '{llm_api.DEFAULT_MODEL}' AS model, length(text)::BIGINT AS user_len FROM documents")
def request_payload(spark, sf_dir):
    body = documents(spark, sf_dir).select("doc_id", llm_api.request(F.col("text")).alias("body"))
    parsed = F.from_json("body", "model string, messages array<struct<role: string, content: string>>")
    return body.select("doc_id", parsed.alias("r")).select("doc_id", "r.model", F.length(F.get("r.messages", F.lit(1))["content"]).cast("long").alias("user_len"))


@query("response_parse", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {_STRIP('text')} WHEN 2 THEN '' END AS content FROM documents")
def response_parse(spark, sf_dir):
    """Answers with the text, with empty and blank content, without choices, and that are no JSON."""

    def body(content: Column) -> Column:
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"))).alias("choices")))

    k = F.col("doc_id") % 5
    bodies = F.when(k == 0, body(F.col("text"))).when(k == 1, body(F.lit(""))).when(k == 2, body(F.lit(" \n　"))).when(k == 3, F.lit('{"choices": []}')).otherwise(F.left(F.col("text"), F.lit(40)))
    return documents(spark, sf_dir).select("doc_id", llm_api.answer(bodies).alias("content"))


@query(
    "error_classify",
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'nested' WHEN doc_id % 4 = 1 THEN 'flat' ELSE 'raw' END AS kind, left(text, 40) AS message,
CASE WHEN doc_id % 4 = 0 THEN 'limit' END AS type, CASE doc_id % 4 WHEN 0 THEN '429' WHEN 1 THEN source END AS code FROM documents""",
)
def error_classify(spark, sf_dir):
    """Error bodies: nested with and without type and code, flat, and raw text."""
    k, text = F.col("doc_id") % 4, F.left(F.col("text"), F.lit(40)).alias("message")
    nested = F.to_json(F.struct(F.struct(text, F.lit("limit").alias("type"), F.lit("429").alias("code")).alias("error")))
    short = F.to_json(F.struct(F.struct(text).alias("error")))
    flat = F.to_json(F.struct(F.col("source").alias("code"), text))
    bodies = F.when(k == 0, nested).when(k == 1, flat).when(k == 3, short).otherwise(F.left(F.col("text"), F.lit(40)))
    return documents(spark, sf_dir).select("doc_id", llm_api.error(bodies).alias("e")).select("doc_id", "e.*")


@query(
    "upload_records",
    f"""WITH p AS ({_PATHS}), m AS (SELECT doc_id, length({_MARKDOWN(_LABELLED('text', 'mod'))}) > 0 AS good FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 1, 4) AND good THEN 'success' ELSE 'error' END AS status,
CASE WHEN k IN (0, 1, 4) AND good THEN doc_id || CASE k WHEN 4 THEN '.tar' ELSE '' END || '.md' END AS processed_filename FROM p JOIN m USING (doc_id)""",
)
def upload_records(spark, sf_dir):
    """What an upload reports for each file: success and the result's name, or error."""
    docs = named(spark, sf_dir).withColumn("md", markdown(labelled(F.col("text"), mod)))
    good = (paths.file_type(F.col("path")) != "unsupported") & (F.length("md") > 0)
    return docs.select("doc_id", F.when(good, "success").otherwise("error").alias("status"), F.when(good, paths.result_name(F.col("path"))).alias("processed_filename"))


@query(
    "upload_replies",
    f"""WITH m AS (SELECT doc_id, doc_id // 10 AS request, length({_MARKDOWN(_LABELLED('text', 'mod'))}) > 0 AS good FROM documents),
p AS (SELECT doc_id, request, good, k, CASE WHEN k <> 3 AND request % 7 <> 0 THEN string_split(path, '/')[-1] ELSE '' END AS name FROM ({_PATHS}) JOIN m USING (doc_id)),
e AS (SELECT doc_id, request, name, '{{"original_filename":"' || name || CASE WHEN k = 2 THEN '","status":"error","message":"file type not allowed"}}' WHEN NOT good THEN '","status":"error","message":"no result"}}'
ELSE '","status":"success","processed_filename":"' || doc_id || CASE k WHEN 4 THEN '.tar' ELSE '' END || '.md","message":"done"}}' END AS entry FROM p)
SELECT request, CASE WHEN bool_and(name = '') THEN 400 ELSE 200 END AS status,
CASE WHEN bool_and(name = '') THEN '{{"error":"no file was chosen"}}' ELSE '[' || string_agg(entry, ',' ORDER BY doc_id) FILTER (WHERE name <> '') || ']' END AS body FROM e GROUP BY request""",
)
def upload_replies(spark, sf_dir):
    """Requests of ten files, some without a name; every seventh request names none."""
    docs = named(spark, sf_dir).withColumn("request", F.floor(F.col("doc_id") / 10))
    name = F.when((F.col("doc_id") % 5 != 3) & (F.col("request") % 7 != 0), paths.base_name(F.col("path"))).otherwise("")
    return replies(docs.select("request", F.col("doc_id").alias("ix"), name.alias("filename"), markdown(labelled(F.col("text"), mod)).alias("markdown")))


@query("uri_encoded", "SELECT doc_id, replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM documents")
def uri_encoded(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", uri_component(F.col("text")).alias("encoded"))


@query("mask_key", "SELECT doc_id, CASE WHEN length(source) > 4 THEN repeat('*', length(source) - 4) || right(source, 4) ELSE repeat('*', length(source)) END AS masked FROM documents")
def mask_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", mask(F.col("source")).alias("masked"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def escape_html_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


@query("endpoint_url", "SELECT page_id, rtrim(url, '/') || '/chat/completions' AS url FROM pages")
def endpoint_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", llm_api.endpoint(F.col("url")).alias("url"))


@query("config_int", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 3) AND doc_id > 0 THEN doc_id ELSE 5 END::BIGINT AS value FROM documents")
def config_int(spark, sf_dir):
    """Settings as text: a number, a negative one, a word, a padded number, nothing."""
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    value = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.col("source")).when(k == 3, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(F.lit(""))
    return documents(spark, sf_dir).select("doc_id", llm_api.positive_int(value, 5).alias("value"))


@query("preview", "SELECT doc_id, left(text, 100) AS preview FROM documents")
def previews(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", preview(F.col("text")).alias("preview"))


_FILES = f"""WITH m AS (
  SELECT '/in/' || doc_id || '/' || (doc_id % 997) || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.pdf' END AS path, (doc_id % 997) || '.md' AS out_path, {_MARKDOWN(_LABELLED('text'))} AS md FROM documents
), w AS (SELECT *, row_number() OVER (PARTITION BY out_path, length(md) > 0 ORDER BY path) AS k FROM m)
"""


def as_files(docs: DataFrame) -> DataFrame:
    """(path, markdown, error_stage, error) of documents as if each came from a file; names repeat over folders."""
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("/"), (F.col("doc_id") % 997).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".docx").otherwise(".pdf"))
    md = markdown(labelled(F.col("text")))
    rows = docs.select(path.alias("path"), F.when(F.length(md) > 0, md).alias("markdown"))
    return rows.withColumn("error_stage", F.when(F.col("markdown").isNull(), "format")).withColumn("error", F.lit(None).cast("string"))


@query(
    "sink_manifest",
    _FILES + "SELECT path, out_path, CASE WHEN length(md) = 0 THEN 'failed' WHEN k = 1 THEN 'written' ELSE 'collides' END AS status, CASE WHEN length(md) > 0 THEN strlen(md)::BIGINT END AS bytes, CASE WHEN length(md) > 0 THEN sha256(md) END AS sha256, CASE WHEN length(md) = 0 THEN 'format' END AS error_stage FROM w",
)
def sink_manifest(spark, sf_dir):
    """The manifest of the Markdown files of all documents, which the sink has staged, published and counted."""
    return publish(as_files(documents(spark, sf_dir)), scratch(spark, "sink")).manifest.drop("error")


@query("sink_counts", _FILES + "SELECT count(*) FILTER (length(md) > 0) AS processed, count(*) FILTER (length(md) = 0) AS errors, CASE WHEN count(*) FILTER (length(md) = 0) > 0 THEN 1 ELSE 0 END::BIGINT AS exit_code FROM w")
def sink_counts(spark, sf_dir):
    """What the job that wrote the files counted on the way."""
    counts = publish(as_files(documents(spark, sf_dir)), scratch(spark, "sink")).counts
    return spark.range(1).select(*(F.lit(counts[k]).cast("long").alias(k) for k in ("processed", "errors", "exit_code")))


@query("labels_by_content", _RECURSIVE + _LABELLED_CHUNKS + " SELECT sha256('0:' || chunk) AS digest, any_value(t) AS labelled, 1::BIGINT AS n_calls FROM (SELECT c.chunk, l.t FROM labelled l JOIN chunks c USING (doc_id, chunk_ix)) GROUP BY chunk")
def labels_by_content(spark, sf_dir):
    """How often each chunk was labelled in two runs over all documents with one store."""
    store, by_rule = scratch(spark, "labels"), labelled(F.col("chunk"), rule)
    rows = exploded(documents(spark, sf_dir), "doc_id", chunks(F.col("text"), *SMALL), "chunk_ix", "chunk")
    at_once = min(32, spark.sparkContext.defaultParallelism)  # a rule on lines has no limit on calls
    for _ in range(2):
        label_once(rows, lambda part: part.select("digest", by_rule.alias("labelled"), F.lit(None).cast("string").alias("error")), store, at_once=at_once)
    return stored_labels(spark, store).groupBy("digest").agg(F.min("labelled").alias("labelled"), F.count(F.lit(1)).alias("n_calls"))


@query("stream_names", _FILES + "SELECT path, CASE WHEN length(md) > 0 THEN out_path END AS out_path, length(md) > 0 AND k > 1 AS collides FROM w")
def stream_names(spark, sf_dir):
    """Output names of all documents, decided in a stream that keeps the holder of each name."""
    out, source = scratch(spark, "names"), f"{sf_dir}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may be a file, a plain path has to be a folder
    rows = landing.named(as_files(stream)).select("path", "out_path", "collides")
    rows.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "names-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
