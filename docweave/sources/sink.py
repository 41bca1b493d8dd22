"""Markdown files as one unit: staged by tasks, then published with a manifest ordered by path.

1. Tasks write the files of their rows to a staging folder under names of their own, and a row for each. Spark's own commit decides which
   attempts of tasks count, so the rows are complete once that job is.
2. Names are decided from the rows, without the texts: of several inputs with one output name, the least path wins.
3. Winners are moved to their names by tasks. A move that already happened is skipped, so a lost task or a second run does no harm.
4. The manifest, a row for every input, replaces the one before it and the staging folder goes.

A job that fails in step 1 leaves nothing behind. One that fails later leaves a complete staging folder, which ``finish`` publishes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docweave.functions.paths import result_name

MANIFEST = "_manifest"
_STAGING = ".staging-"
_ROWS = "path string, out_path string, staged string, bytes long, sha256 string, error_stage string, error string"


@dataclass(frozen=True)
class Published:
    """manifest: path, out_path, status (written, collides or failed), bytes, sha256, error_stage, error; ordered by path. counts: as convert.summary(), from the job that wrote."""

    manifest: DataFrame
    counts: dict[str, int]


def counted(results: DataFrame, observation: Observation | str, ok: str = "markdown is not null") -> DataFrame:
    """results, which on their way to whatever reads them also count themselves: processed and errors, as convert.summary() does."""
    return results.observe(observation, F.count_if(F.expr(ok)).alias("processed"), F.count_if(~F.expr(ok)).alias("errors"))


def exit_code(counts: dict[str, int]) -> dict[str, int]:
    return {**counts, "exit_code": int(counts["errors"] > 0)}


def _stager(folder: str):
    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = files.FileSystem.from_uri(folder)
        for batch in batches:
            staged, sizes, digests = [], [], []
            for text in batch["markdown"]:
                name = None if text is None else f"{uuid.uuid4().hex}.md"
                if name is not None:
                    store.create_dir(base, recursive=True)
                    data = text.encode()
                    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                        out.write(data)
                staged.append(name)
                sizes.append(None if name is None else len(data))
                digests.append(None if name is None else hashlib.sha256(data).hexdigest())
            rows = batch[["path", "out_path"]].assign(staged=staged, sha256=digests)
            yield rows.assign(bytes=pd.array(sizes, "Int64"), error_stage=batch["error_stage"], error=batch["error"])[[c.split()[0] for c in _ROWS.split(", ")]]

    return stage


def _mover(source: str, folder: str):
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, at), (_, base) = files.FileSystem.from_uri(source), files.FileSystem.from_uri(folder)
        for batch in batches:
            for staged, name in zip(batch["staged"], batch["out_path"]):
                if store.get_file_info(f"{at}/{staged}").type != files.FileType.NotFound:
                    store.move(f"{at}/{staged}", f"{base}/{name}")
            yield batch[["staged"]]

    return move


def _published(spark: SparkSession, folder: str, staging: str) -> DataFrame:
    """Steps 2 to 4 for a complete staging folder."""
    rows = spark.read.schema(_ROWS).parquet(f"{staging}/rows")
    first = rows.where("staged is not null").groupBy("out_path").agg(F.min(F.struct("path", "staged")).alias("_first"))
    winners = first.select("out_path", F.col("_first.staged").alias("staged"))
    winners.mapInPandas(_mover(f"{staging}/files", folder), "staged string").write.mode("overwrite").parquet(f"{staging}/moved")
    moved = spark.read.schema("staged string").parquet(f"{staging}/moved").select(F.col("staged").alias("_moved"))
    status = F.when(F.col("staged").isNull(), "failed").when(F.col("_moved").isNull(), "collides").otherwise("written")
    manifest = rows.join(moved, F.col("staged") == F.col("_moved"), "left").select("path", "out_path", status.alias("status"), "bytes", "sha256", "error_stage", "error")
    manifest.orderBy("path").write.mode("overwrite").parquet(f"{staging}/manifest")
    store, base = files.FileSystem.from_uri(folder)
    at = files.FileSystem.from_uri(staging)[1]
    if store.get_file_info(f"{base}/{MANIFEST}").type != files.FileType.NotFound:
        store.delete_dir(f"{base}/{MANIFEST}")
    store.move(f"{at}/manifest", f"{base}/{MANIFEST}")
    store.delete_dir(at)
    return spark.read.schema(manifest.schema).parquet(f"{folder}/{MANIFEST}")


def publish(results: DataFrame, folder: str) -> Published:
    """Write the Markdown of results (path, markdown, and error_stage and error where there are such columns) below folder, a URI that all executors reach.

    The results are computed once, and counted while they are written.
    """
    spark, staging, seen = results.sparkSession, f"{folder.rstrip('/')}/{_STAGING}{uuid.uuid4().hex}", Observation()
    extra = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in ("error_stage", "error")]
    rows = counted(results, seen).select("path", result_name(F.col("path")).alias("out_path"), "markdown", *extra)
    store, at = files.FileSystem.from_uri(staging)
    try:
        rows.mapInPandas(_stager(f"{staging}/files"), _ROWS).write.parquet(f"{staging}/rows")
    except BaseException:
        if store.get_file_info(at).type != files.FileType.NotFound:
            store.delete_dir(at)
        raise
    counts = exit_code(seen.get)
    return Published(_published(spark, folder.rstrip("/"), staging), counts)


def finish(spark: SparkSession, folder: str) -> int:
    """Publish what earlier jobs have staged as a whole and remove what they haven't; returns how many were published. Not for a folder that a job writes to just now."""
    store, base = files.FileSystem.from_uri(folder.rstrip("/"))
    done = 0
    for info in store.get_file_info(files.FileSelector(base, allow_not_found=True)):
        if not info.base_name.startswith(_STAGING):
            continue
        if store.get_file_info(f"{info.path}/rows/_SUCCESS").type == files.FileType.NotFound:
            store.delete_dir(info.path)
        else:
            _published(spark, folder.rstrip("/"), f"{folder.rstrip('/')}/{info.base_name}")
            done += 1
    return done
