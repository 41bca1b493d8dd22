"""The whole conversion: raw text to Markdown, one row per document, without a shuffle; with a labeler of rows, by chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import blank, tokens
from docweave.operators.label import Labeler, labelled, markdown, rule
from docweave.operators.merge import merged
from docweave.operators.segment import MAX_TOKENS, OVERLAP_TOKENS, chunks
from docweave.sources.files import MAX_BYTES, PdfReader, extracted, rejects, scan
from docweave.sources.labels import label_once, reason


def convert(docs: DataFrame, text: str = "text", labeler: Labeler = rule, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, clean: bool = False) -> DataFrame:
    """docs with n_tokens, route, markdown (null where a stage failed) and error_stage (null where none did).

    Texts of up to max_tokens are labelled as they are; longer ones are split, labelled chunk by chunk and merged.
    clean leaves out chunks that only repeat. Stages that can fail: extract (no text), split (no chunk), merge (nothing left), format (no block).
    """
    t = F.col(text)
    out = docs.withColumn("n_tokens", tokens(t)).withColumn("route", F.when(F.col("n_tokens") <= max_tokens, "direct").otherwise("chunked"))
    parts = F.transform(chunks(t, max_tokens, overlap, clean), lambda c: labelled(c, labeler))
    out = out.withColumn("_parts", F.when(F.col("route") == "chunked", parts))
    out = out.withColumn("_labelled", F.when(F.col("route") == "direct", labelled(t, labeler)).otherwise(merged(F.col("_parts"), overlap)))
    out = out.withColumn("_md", markdown(F.col("_labelled")))
    chunked = F.col("route") == "chunked"
    stage = (
        F.when(t.isNull(), "extract")
        .when(chunked & (F.size("_parts") == 0), "split")
        .when(chunked & blank(F.col("_labelled")), "merge")
        .when(F.length("_md") == 0, "format")
    )
    return out.withColumn("error_stage", stage).withColumn("markdown", F.when(stage.isNull(), F.col("_md"))).drop("_parts", "_labelled", "_md")


def convert_files(spark: SparkSession, path: str, pdf_pages: PdfReader | None = None, recursive: bool = False, max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """(path, markdown, error_stage, error) of every file of a folder: those that can't be converted (type, size, extract, ...) are rows too."""
    texts = extracted(scan(spark, path, recursive, max_bytes), pdf_pages, isolate=True)
    done = convert(texts, text="raw_text", **options).select("path", "markdown", "error_stage", "error")
    left_out = rejects(spark, path, recursive, max_bytes).select("path", F.lit(None).cast("string").alias("markdown"), "error_stage", "error")
    return done.unionByName(left_out)


def chunk_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, clean: bool = False) -> DataFrame:
    """(key, chunk_ix, chunk): what a service has to label. Texts of up to max_tokens are one chunk as they are; null texts have none."""
    t = F.col(text)
    pieces = F.when(tokens(t) <= max_tokens, F.array(t)).otherwise(chunks(t, max_tokens, overlap, clean))
    rows = docs.where(t.isNotNull()).select(F.col(key).alias(key), F.posexplode(pieces).alias("chunk_ix", "chunk"))
    return rows.withColumn("chunk_ix", F.col("chunk_ix").cast("long"))


def assembled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """key, n_tokens, route, markdown, error_stage and error of each document from the labels (key, chunk_ix, labelled, error) of its chunks.

    One chunk without a label fails its document (stage label), with the first such chunk's error. Labels come in any order. Only sizes of
    docs are joined, not texts. Keys are unique; a chunk has one row in labels.
    """
    t, failed = F.col(text), F.col("labelled").isNull()
    sized = docs.select(F.col(key).alias(key), tokens(t).alias("n_tokens"), t.isNull().alias("_missing"))
    found = labels.groupBy(F.col(key).alias("_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "labelled"))), lambda c: c["labelled"]).alias("_parts"),
        F.count_if(failed).alias("_failed"),
        F.min_by(F.coalesce(reason(labels), F.lit("no label")), F.when(failed, F.col("chunk_ix"))).alias("_error"),
    )
    out = sized.join(found, F.col(key) == F.col("_key"), "left").withColumn("route", F.when(F.col("n_tokens") <= max_tokens, "direct").otherwise("chunked"))
    chunked, whole = F.col("route") == "chunked", F.coalesce(F.col("_failed"), F.lit(0)) == 0
    out = out.withColumn("_labelled", F.when(whole & chunked, merged(F.col("_parts"), overlap)).when(whole, F.get("_parts", F.lit(0)))).withColumn("_md", markdown(F.col("_labelled")))
    stage = (
        F.when(F.col("_missing"), "extract")
        .when(~whole, "label")
        .when(F.col("_parts").isNull(), "split")
        .when(chunked & blank(F.col("_labelled")), "merge")
        .when(F.length("_md") == 0, "format")
    )
    out = out.withColumn("error_stage", stage)
    return out.select(key, "n_tokens", "route", F.when(stage.isNull(), F.col("_md")).alias("markdown"), "error_stage", F.when(F.col("error_stage") == "label", F.col("_error")).alias("error"))


def convert_by_rows(docs: DataFrame, label: Callable[[DataFrame], DataFrame], store: str | None = None, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, clean: bool = False, setting: str | None = None) -> DataFrame:
    """The conversion with a labeler of rows, such as ``lambda rows: remote.label(rows, service, (key, "chunk_ix"))``.

    label takes chunk_rows() and adds labelled and error. Calls to a service aren't repeatable and cost money, so its labels are written to
    store (a new path that all executors reach) once, and everything after reads them there. With setting, which names whatever else decides a
    label (model, prompt), store may also be one of sources.labels, whose labels are used again: label then gets rows (digest, chunk).
    """
    if setting is not None:
        return assembled(docs, label_once(chunk_rows(docs, key, text, max_tokens, overlap, clean), label, store, setting), key, text, max_tokens, overlap)
    labels = label(chunk_rows(docs, key, text, max_tokens, overlap, clean))
    if store is not None:
        labels.write.parquet(store)
        labels = docs.sparkSession.read.schema(labels.schema).parquet(store)
    return assembled(docs, labels, key, text, max_tokens, overlap)


def summary(results: DataFrame) -> DataFrame:
    """One row: processed, errors, exit_code. results has the column ok."""
    counts = results.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("errors"))
    return counts.withColumn("exit_code", F.when(F.col("errors") == 0, 0).otherwise(1).cast("long"))
