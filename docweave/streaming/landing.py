"""Convert documents as their files arrive in a folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.functions.paths import file_type, result_name
from docweave.jobs.convert import convert
from docweave.sources.files import MAX_BYTES, PdfReader, extracted, left_out
from docweave.sources.sink import counted

#: The name under which a batch's counts stand in the progress of its query.
COUNTS = "conversion"


def files_of(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of all files of a folder: (path, length, content, file_type). Contents of files that a filter on length leaves out aren't read."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return stream.select("path", "length", "content", file_type(F.col("path")).alias("file_type"))


def _supported(max_bytes: int) -> Column:
    return (F.col("file_type") != "unsupported") & (F.col("length") <= max_bytes)


def arriving(spark: SparkSession, folder: str, max_files: int = 1000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Stream of the supported files of a folder: (path, file_type, content)."""
    return files_of(spark, folder, max_files).where(_supported(max_bytes)).select("path", "content", "file_type")


def converted(stream: DataFrame, pdf_pages: PdfReader | None = None, max_bytes: int = MAX_BYTES, rejects: bool = True, **options) -> DataFrame:
    """(path, markdown, error_stage, error) of the files of files_of(): one source, whose accepted files are converted and, with rejects, whose others are rows with a reason."""
    taken = stream.where(_supported(max_bytes)).select("path", "content", "file_type")
    done = convert(extracted(taken, pdf_pages, isolate=True), text="raw_text", **options).select("path", "markdown", "error_stage", "error")
    if not rejects:
        return done
    others = left_out(stream.where(~_supported(max_bytes)), max_bytes).select("path", F.lit(None).cast("string").alias("markdown"), "error_stage", "error")
    return done.unionByName(others)


def named(results: DataFrame) -> DataFrame:
    """A stream of results with out_path and collides: the first file of a name has it for good, and later ones are marked, in this batch (by path) or any other.

    The state of a name is the path that has it. Only where a name is new are its rows of the batch held, of which there are no more than max_files.
    Results without Markdown take no name and aren't dealt by it.
    """

    def mark(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        batches = list(batches) if holder is None else batches  # the first batch of a name decides by its least path
        if holder is None:
            holder = min(b["path"].min() for b in batches)
            state.update((holder,))
        for batch in batches:
            yield batch.assign(collides=batch["path"] != holder)

    rows = results.withColumn("out_path", F.when(F.col("markdown").isNotNull(), result_name(F.col("path"))))
    good = rows.where("out_path is not null").select("path", "out_path", "markdown", "error_stage", "error")
    marked = good.groupBy("out_path").applyInPandasWithState(mark, "path string, out_path string, markdown string, error_stage string, error string, collides boolean", "path string", "append", GroupStateTimeout.NoTimeout)
    bad = rows.where("out_path is null").select("path", "out_path", "markdown", "error_stage", "error", F.lit(False).alias("collides"))
    return marked.unionByName(bad)


def convert_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, pdf_pages: PdfReader | None = None, max_files: int = 1000, max_bytes: int = MAX_BYTES, rejects: bool = False, **options) -> StreamingQuery:
    """Append (path, out_path, collides, markdown, error_stage, error) of each new file to Parquet at out; the checkpoint makes that exactly once.

    Files that can't be read, PDFs without a reader among them, have a null Markdown and the reason; the stream goes on. With rejects, so have files of
    another type or above max_bytes, and every file has a row. Counts of each batch stand in the query's progress, see counts().
    """
    rows = counted(named(converted(files_of(spark, folder, max_files), pdf_pages, max_bytes, rejects, **options)), COUNTS)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def counts(query: StreamingQuery) -> dict[str, int]:
    """processed and errors of the batches that the query still remembers (spark.sql.streaming.numRecentProgressUpdates), taken while they were written."""
    seen = [p.observedMetrics[COUNTS].asDict() for p in query.recentProgress if COUNTS in (p.observedMetrics or {})]
    return {k: sum(s[k] for s in seen) for k in ("processed", "errors")}
