"""The stages of a conversion as temporary views, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import filled_lines, tokens
from docweave.jobs.convert import convert
from docweave.operators.label import Labeler, rule
from docweave.operators.segment import MAX_TOKENS, OVERLAP_TOKENS, chunks


def create_views(docs: DataFrame, prefix: str = "doc_", text: str = "text", key: str = "doc_id", labeler: Labeler = rule, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Create <prefix>sizes, chunks, lines and markdown; each is computed from docs when it is queried. Returns the names."""
    t = F.col(text)
    route = F.when(tokens(t) <= max_tokens, "direct").otherwise("chunked")
    parts = docs.select(key, F.posexplode(chunks(t, max_tokens, overlap)).alias("chunk_ix", "chunk"))
    lines = docs.select(key, F.posexplode(filled_lines(t)).alias("line_ix", "content"))
    views = {
        "sizes": docs.select(key, tokens(t).alias("n_tokens"), route.alias("route")),
        "chunks": parts.withColumn("n_tokens", tokens(F.col("chunk"))),
        "lines": lines.withColumn("label", labeler(F.col("content"))),
        "markdown": convert(docs.select(key, t), text, labeler, max_tokens, overlap).select(key, "route", "markdown", "error_stage"),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
