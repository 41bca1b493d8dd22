"""A store of labels by content: equal chunks are labelled once, and a run that died pays only for what it hadn't stored.

The store is a folder of Parquet files, in folders of their own for each run, with a row (digest, labelled, error, run) for each call. Calls are made in
waves, each a Spark job of its own that adds to the store when it ends, so a run that dies loses one wave at most, or those that ran at once.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.sources.scratch import discard, scratch, shuffles_removed

MAX_WAVES = 4096
_STORED = "digest string, labelled string, error string, run string"
_PENDING = "digest string, chunk string"


def digest(chunk: Column, setting: str = "") -> Column:
    """What a chunk is stored under. setting is whatever else decides the label, such as model and prompt."""
    return F.sha2(F.concat(F.lit(f"{len(setting.encode())}:{setting}"), chunk).cast("binary"), 256)


def stored_labels(spark: SparkSession, store: str) -> DataFrame:
    """All rows of the store; none where there is no store yet."""
    try:
        return spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException:  # no such path
        return spark.createDataFrame([], _STORED)


def reason(labels: DataFrame) -> Column:
    """The message of the column error, a string or a struct with one."""
    return F.col("error.message") if isinstance(labels.schema["error"].dataType, StructType) else F.col("error")


def dealt(files: list[tuple[str, int]], wave: int) -> list[list[str]]:
    """Names of (name, texts) in waves of up to ``wave`` texts, or a MAX_WAVES-th of all where that is more. No file has more than ``wave``."""
    most = max(wave, -(-sum(n for _, n in files) // MAX_WAVES))
    waves, room = [], 0
    for name, n in sorted(files, key=lambda f: (-f[1], f[0])):
        if n > room:
            waves.append([])
            room = most
        waves[-1].append(name)
        room -= n
    return waves


def in_slots(spark: SparkSession, work: Callable[[int, list[str]], None], waves: list[list[str]], at_once: int) -> None:
    """work(slot, wave) for each wave, in order, up to at_once beside each other. Once one fails, no more begin."""
    left = deque(waves)

    def slot(k: int) -> None:
        while True:
            try:
                wave = left.popleft()
            except IndexError:
                return
            try:
                work(k, wave)
            except BaseException:
                left.clear()
                raise

    if at_once <= 1:
        return slot(0)
    with ThreadPoolExecutor(at_once) as pool:
        for _ in pool.map(inheritable_thread_target(spark)(slot), range(at_once)):
            pass


def label_once(chunks: DataFrame, label: Callable[[DataFrame], DataFrame], store: str, setting: str = "", wave: int = 10_000, text: str = "chunk", at_once: int = 1) -> DataFrame:
    """chunks with labelled and error; label is called for each text that the store has no label of, once.

    label takes rows (digest, chunk) and gives digest, labelled and error of each. A call that fails is stored with its reason, and the next run tries
    it again. A wave has about ``wave`` calls, or a MAX_WAVES-th of all where that is more. at_once waves run beside each other: more than one is for labelers that
    run in the tasks, not for a service that takes so many calls at once, and label then runs in threads. Texts meet by digest: only texts to be labelled are shuffled,
    one of each, and staged in files of up to ``wave``, so that a wave reads files of its own, which go when it ends. chunks is computed once where the store has no label yet, else once to see
    whether anything is missing and again if so; what is returned computes it when used. Null chunks have no label.
    """
    spark, run = chunks.sparkSession, uuid.uuid4().hex
    keyed = chunks.withColumn("_digest", digest(F.col(text), setting))
    known = stored_labels(spark, store).where("labelled is not null").select("digest")
    todo = keyed.where(F.col(text).isNotNull()).select(F.col("_digest").alias("digest"), F.col(text).alias("chunk")).groupBy("digest").agg(F.any_value("chunk").alias("chunk"))
    first = known.isEmpty()
    if not first:
        todo = todo.join(known, "digest", "left_anti")
    pending = scratch(spark, "pending-labels")
    with shuffles_removed(spark):
        if first or not todo.isEmpty():
            todo.write.mode("append").option("maxRecordsPerFile", wave).option("compression", "zstd").parquet(pending)
    files = spark.read.schema(_PENDING).parquet(pending).groupBy("_metadata.file_name").count().collect()

    def add(slot: int, names: list[str]) -> None:
        paths = [f"{pending}/{name}" for name in names]
        found = label(spark.read.schema(_PENDING).parquet(*paths))
        found.select("digest", "labelled", reason(found).alias("error"), F.lit(run).alias("run")).write.mode("append").option("compression", "zstd").parquet(f"{store}/{run}-{slot}")  # one writer a folder
        for path in paths:
            discard(spark, path)

    in_slots(spark, add, dealt([(f["file_name"], f["count"]) for f in files], wave), at_once)
    discard(spark, pending)
    best = stored_labels(spark, store).where(F.col("labelled").isNotNull() | (F.col("run") == run)).groupBy(F.col("digest").alias("_of")).agg(F.min("labelled").alias("labelled"), F.min("error").alias("_error"))
    joined = keyed.drop("labelled", "error").join(best, F.col("_digest") == F.col("_of"), "left")
    return joined.withColumn("error", F.when(F.col("labelled").isNull(), F.col("_error"))).drop("_digest", "_of", "_error")
