"""Put groups of documents into shards of near equal size: best-fit-decreasing bin packing."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import stored, tidy

#: Rows that one task numbers.
ROWS_A_SLICE = 20_000


class FreeSpace:
    """Bins ordered by (free space, bin) in a treap: a binary tree that random priorities keep balanced."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._draw = random.Random(0)

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, free: int, bin_no: int) -> None:
        low, high = self._split(self._root, (free, bin_no))
        self._root = self._merge(self._merge(low, [(free, bin_no), self._draw.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least free space that still holds size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        up, node = None, high
        while node[2] is not None:
            up, node = node, node[2]
        if up is None:
            high = node[3]
        else:
            up[2] = node[3]
        self._root = self._merge(low, high)
        return node[0]


def fill(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit of (size, number of items), largest size first: how many items of a size go to which bin, as (size, bin, number).

    An item enters the bin with the least free space that holds it. For the next item of that size, this bin is the tightest
    still, as long as it holds the item, so a bin takes as many at once as it can. None if more than ``most`` bins are needed.
    """
    space, bins, out = FreeSpace(), 0, []
    for size, number in sizes:
        while number:
            found = space.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            taken = min(number, max(1, found[0] // size))
            out.append((size, found[1], taken))
            space.add(found[0] - taken * size, found[1])
            number -= taken
    return out


def plan(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, number) for (size, number of groups). A group above the mean of what is left has a shard alone.

    The others are packed at the mean of what is left, or else at the first capacity beyond it, in doubling steps, that needs no more shards.
    """
    rest, out, first = [[size, number] for size, number in sorted(sizes, reverse=True)], [], 0
    left = sum(size * number for size, number in rest)
    while rest and first < shards - 1 and rest[0][0] * (shards - first) > left:
        out.append((rest[0][0], first, 1))
        left -= rest[0][0]
        first, rest[0][1] = first + 1, rest[0][1] - 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return out
    low, slack = max(rest[0][0], -(-left // (shards - first))), 0
    while (found := fill(rest, low + slack, shards - first)) is None:
        slack = max(1, 2 * slack)
    return out + [(size, first + k, number) for size, k, number in found]


def _dealt(items: list[tuple[int, object]], placed: list[tuple[int, int, int]]) -> list[tuple[int, object, int]]:
    """(size, name, bin): the items of a size, by name, take its places one after another."""
    names: dict[int, list] = {}
    for size, name in sorted(items, key=lambda x: str(x[1]), reverse=True):
        names.setdefault(size, []).append(name)
    return [(size, names[size].pop(), k) for size, k, number in placed for _ in range(number)]


def _counted(items: list[tuple[int, object]]) -> list[tuple[int, int]]:
    return sorted(Counter(size for size, _ in items).items(), reverse=True)


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int) -> list[list]:
    """Bins of items (size, name), none above capacity; the largest item comes first and goes where it fits most tightly."""
    bins: dict[int, list] = {}
    for size, name, k in _dealt(items, fill(_counted(items), capacity)):
        bins.setdefault(k, []).append((size, name))
    return [bins[k] for k in sorted(bins)]


def pack(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Name to shard, by plan()."""
    return {name: k for _, name, k in _dealt(items, plan(_counted(items), shards))}


def _numbered(rows: DataFrame, key: str, most: int, order: list[str]) -> DataFrame:
    """Add ``_rank``: the place of a row among those of its key, from 0.

    Rows of a key are numbered in slices of about ROWS_A_SLICE (most is the largest number of rows of a key), after the rows of the slices
    before, so no task has to sort a hot key.
    """
    slices = max(1, -(-most // ROWS_A_SLICE))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_slice").orderBy(*order)
    return sliced.withColumn("_at", F.row_number().over(own)).join(starts, [key, "_slice"]).withColumn("_rank", (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_slice", "_at", "_start")


def _group(text: str) -> Column:
    """Tells texts apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _group_shards(slim: DataFrame, shards: int) -> DataFrame:
    """(_group, shard) of all groups of slim (_group, size), stored."""
    groups = stored(slim.groupBy("_group").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = [tuple(r) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]  # bounded, see shard_by_bytes()
    places, taken = [], Counter()
    for size, shard, number in plan(sizes, shards):
        places.append((size, taken[size], taken[size] + number, shard))
        taken[size] += number
    places = stored(slim.sparkSession.createDataFrame(places, "_bytes long, _from long, _to long, shard int"), "shard-places")
    ranked = _numbered(groups, "bytes", max((n for _, n in sizes), default=0), ["_group"])
    inside = (F.col("bytes") == F.col("_bytes")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return stored(ranked.join(places, inside).select("_group", "shard"), "group-shards")


@tidy
def shard_by_bytes(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot.

    Documents with equal texts are one indivisible group, and every group goes through best-fit-decreasing packing. The driver
    holds how many groups there are of each size, not groups: k different sizes are k * (k + 1) / 2 bytes at least, so there are at most
    the square root of twice all bytes. Groups of one size are then numbered and dealt to the places that the packing gives to that size.
    A group above the mean shard size has a shard alone. Null and empty texts have size 1 and are one group; very long texts are groups like others.
    Ids may be null or repeated (ties in slots then follow checksum and size). Other columns aren't looked at. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), _group(text).alias("_group")), "shard-rows")
    placed = slim.join(_group_shards(slim, shards), "_group")
    numbered = _numbered(placed, "shard", -(-slim.count() // shards), ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("_rank").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text", column: str = "out_shard") -> None:
    """Write docs, with all their columns, as one folder per shard (named by column) below path. Every row is written once, whatever its id."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stored(docs.select(_group(text).alias("_group"), (F.octet_length(body) + 1).cast("long").alias("size")), "shard-rows")
    of = _group_shards(slim, shards).select(F.col("_group").alias("__shard_group"), F.col("shard").alias(column))
    docs.join(of, _group(text) == F.col("__shard_group")).drop("__shard_group").write.partitionBy(column).parquet(path)


def _contract(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return _contract(shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
