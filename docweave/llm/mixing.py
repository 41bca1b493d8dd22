"""Mix sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import NOT_SPACE, stored, tidy

#: Range partitions that the ranking of the sources uses, and so the most rows it brings to the driver.
RANK_PARTITIONS = 8


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def _ranked(per_source: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0, by code point, null last) without sorting everything in one task.

    Sources are range-partitioned and sorted; each partition counts its own rows and only the
    RANK_PARTITIONS counts come together.
    """
    order = F.col("source").asc_nulls_last()
    parts = stored(
        per_source.repartitionByRange(RANK_PARTITIONS, order)
        .sortWithinPartitions(order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))),
        "sources",
    )
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts += [F.lit(part), F.lit(before)]
        before += n
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    return parts.withColumn("rank", F.col("_at") + start).drop("_at", "_part")


@tidy
def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target.

    sized has ``source`` and ``size``. Sources by code point (null last) weigh ``weights``, repeating, and share
    ``share`` times all sizes. A target stops at ``most`` times its source's size; the excess is shared out again
    by weight among the others until no target is above. Only sums over the sources reach the driver.
    An empty table gives no rows; sources without words have target 0.
    """
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight).drop("rank"), "source-weights")
    total, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, left_weight = share * (total or 0), all_weight
    total_share, cap = left, F.col("source_size") * F.lit(float(most))
    while left_weight:
        above = F.col("weight") * F.lit(float(left)) / F.lit(float(left_weight)) > cap
        taken, heavy = table.agg(F.sum(F.when(above, cap)), F.sum(F.when(above, F.col("weight")))).first()
        left, next_weight = total_share - (taken or 0.0), all_weight - (heavy or 0)
        if next_weight == left_weight:
            break
        left_weight = next_weight
    fair = F.col("weight") * F.lit(float(left)) / F.lit(float(left_weight or 1))
    return stored(table.withColumn("target", F.least(fair, cap) if left_weight else cap), "source-targets")


def copies(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    """floor(rate), plus one where a hash of the id falls below the fraction: the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    chance = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("long")


def with_copies(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """docs with source_size, target and copies.

    The targets have a row per source. Spark broadcasts them while their file is below its threshold and else
    joins by hash, where adaptive execution splits a hot source.
    """
    of = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return docs.join(of, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("copies", copies(rate, F.col(doc_id), seed))


@tidy
def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, **shares) -> DataFrame:
    """Every document as often as its source's rate asks for; the columns stay those of docs.

    Null and empty texts have no words, very long ones are counted whole. A document whose source has rate 0 is not emitted. Repeated rows
    (and all rows of null ids) are each emitted by the same draw. An empty table gives no rows.
    """
    targets = source_targets(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), **shares)
    of = targets.select(F.col("source").alias("__mix_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__mix_rate"))
    return (
        docs.join(of, F.col(source).eqNullSafe(F.col("__mix_source")), "left")
        .select(*docs.columns, copies(F.col("__mix_rate"), F.col(doc_id), seed).alias("__mix_copies"))
        .where("__mix_copies > 0")
        .withColumn("__mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))))
        .drop("__mix_copies")
    )


@tidy
def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = with_copies(sized, source_targets(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


OP7_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source
), fill(step, spare, weight) AS (
  SELECT 0, 1.5::DOUBLE * (SELECT sum(s) FROM per)::DOUBLE, (SELECT sum(w) FROM per)::DOUBLE
  UNION ALL
  SELECT step + 1,
         1.5::DOUBLE * (SELECT sum(s) FROM per)::DOUBLE - coalesce((SELECT sum(s * 2.0::DOUBLE) FROM per WHERE w * spare / weight > s * 2.0::DOUBLE), 0),
         (SELECT sum(w) FROM per)::DOUBLE - coalesce((SELECT sum(w) FROM per WHERE w * spare / weight > s * 2.0::DOUBLE), 0)
  FROM fill WHERE step < 60 AND weight > 0
), done AS (SELECT spare, weight FROM fill WHERE step = (SELECT max(step) FROM fill)),
goal AS (SELECT source, s, least(w * (SELECT spare FROM done) / (SELECT weight FROM done), s * 2.0::DOUBLE) AS target FROM per),
drawn AS (
  SELECT d.doc_id, d.size, g.s AS source_size, g.target, d.source,
         CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), counted AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM counted
"""
