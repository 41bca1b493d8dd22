"""A Merkle manifest of a dataset: a hash tree of arity 8 over its rows, in blocks that are laid out in van Emde Boas order.

Rows are leaves, in order within their group; a tree stands over each group and one over the groups' roots. A tree is cut
into aligned subtrees (blocks) of 8 ** ``levels`` leaves. One Spark group is one block: its nodes are stored as one binary value in
van Emde Boas order, in which a subtree's upper half of levels comes first and each subtree below it follows as a unit, split the same way
again. The blocks' roots are the leaves of the next round, so that a round is 8 ** levels times smaller than the one before.
Proofs go the other way: a block's rows take their siblings by address from its nodes and add what stands above the block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import ascii_lower, stored, tidy

ARITY = 8
_DIGEST = 32
PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Settings:
    """A block has 8 ** ``levels`` leaves."""

    levels: int = 3


# Digests.


def field(value: Column) -> Column:
    """A value within a leaf: - for null, else its bytes' count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row, of its values in this order; values of any type that has one text."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that digest and its siblings give."""
    return F.aggregate(path, digest, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


# A block: addresses, construction, siblings.


def tree_size(levels: int) -> int:
    """Nodes of a complete subtree of so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Where the index-th node of a depth (0: the root) stands in a subtree of so many levels of nodes."""
    base = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            depth, levels = depth - top, levels - top
            base += tree_size(top) + index // ARITY**depth * tree_size(levels)
            index %= ARITY**depth
    return base


@functools.cache
def addresses(levels: int) -> list[np.ndarray]:
    """address() of all nodes of each depth."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top = levels // 2
    bases = tree_size(top) + np.arange(ARITY**top) * tree_size(levels - top)
    return addresses(top) + [(bases[:, None] + at[None, :]).ravel() for at in addresses(levels - top)]


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def build(nodes: np.ndarray, base: int, levels: int, leaves: list[bytes]) -> bytes:
    """Fill the subtree at base from its leaves (as many as there are, from the left) and return its root: the subtrees below first, then the one above them over their roots."""
    if levels == 1:
        nodes[base] = np.frombuffer(leaves[0], np.uint8)
        return leaves[0]
    top, low = levels // 2, levels - levels // 2
    width, first = ARITY ** (low - 1), base + tree_size(top)
    roots = [build(nodes, first + k * tree_size(low), low, leaves[k * width : (k + 1) * width]) for k in range(-(-len(leaves) // width))]
    return build(nodes, base, top, [parent(roots[k : k + ARITY]) for k in range(0, len(roots), ARITY)])


def block_levels(leaves: int, total: int, most: int) -> int:
    """Levels of nodes of a block: all below a further round, and only as many as join the leaves to one where there is none."""
    if total > ARITY**most:
        return most + 1
    levels = 1
    while ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels


def paths(nodes: np.ndarray, levels: int, leaves: int) -> list[list[tuple[str, str]]]:
    """The siblings (left, right) of each leaf of a block, from its own level up."""
    steps, count = [], leaves
    for at in reversed(addresses(levels)[1:]):
        digests = [nodes[a].tobytes().hex() for a in at[:count]]
        steps.append([("".join(digests[k // ARITY * ARITY : k]), "".join(digests[k + 1 : (k // ARITY + 1) * ARITY])) for k in range(count)])
        count = -(-count // ARITY)
    return [[step[k // ARITY**up] for up, step in enumerate(steps)] for k in range(leaves)]


# Rounds over tables.


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, stored, with _rank: the place among those of their _group by order (null first), from 0, and _total, their number.

    Rows are dealt by range over group and order together and numbered within their partition; the numbers of rows that come before
    are added for each partition, so that no task sorts a group. Rows that are equal in all of order may meet in one partition.
    """
    placed = stored(rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(F.col("_group").alias("_of"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_of")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_of", "_part", (before - F.col("_first")).alias("_start"), F.sum("_n").over(group).alias("_total"))
    return placed.join(starts, (F.col("_group") == F.col("_of")) & (part == F.col("_part"))).withColumn("_rank", F.col("_at") + F.col("_start")).drop("_of", "_part", "_start", "_at")


def blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """A row per block of (_group, _rank, _total, digest, item): _group, _block, _total, n, items in order, root, and nodes in van Emde Boas order; stored."""
    size = ARITY**settings.levels
    member = F.struct("_rank", F.unhex("digest").alias("digest"), "item")
    whole = rows.groupBy("_group", F.floor(F.col("_rank") / size).alias("_block")).agg(F.first("_total").alias("_total"), F.array_sort(F.collect_list(member)).alias("_rows"))
    levels = settings.levels

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for total, digests in zip(batch.column("_total").to_pylist(), batch.column("_digests").to_pylist()):
                depth = block_levels(len(digests), total, levels)
                nodes = np.zeros((tree_size(depth), _DIGEST), np.uint8)
                out.append((build(nodes, 0, depth, digests).hex(), nodes.tobytes(), len(digests)))
            root, nodes_, n = zip(*out) if out else ((), (), ())
            kept = [batch.column(c) for c in ("_group", "_block", "_total", "items")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(root, pa.string()), pa.array(nodes_, pa.binary()), pa.array(n, pa.int32())], names=["_group", "_block", "_total", "items", "root", "nodes", "n"])

    parts = whole.select("_group", "_block", "_total", F.transform("_rows", lambda r: r["item"]).alias("items"), F.transform("_rows", lambda r: r["digest"]).alias("_digests"))
    item = dict(rows.dtypes)["item"]
    return stored(parts.mapInArrow(nodes_of, f"_group string, _block long, _total long, items array<{item}>, root string, nodes binary, n int"), "merkle-blocks")


def rounds(rows: DataFrame, most: int, settings: Settings) -> list[DataFrame]:
    """The blocks of rows, those of these blocks' roots, and so on; most is the largest number of rows of a group."""
    found = [blocks(rows, settings)]
    while most > ARITY**settings.levels:
        most = -(-most // ARITY**settings.levels)
        roots = found[-1].where(F.col("_total") > ARITY**settings.levels)
        total = F.ceil(F.col("_total") / ARITY**settings.levels).cast("long")
        found.append(blocks(roots.select("_group", F.col("_block").alias("_rank"), total.alias("_total"), F.col("root").alias("digest"), F.struct(F.lit(0).alias("none")).alias("item")), settings))
    return found


def tops(found: list[DataFrame], settings: Settings) -> DataFrame:
    """(_group, root) of each group."""
    return functools.reduce(DataFrame.union, (b.where(F.col("_total") <= ARITY**settings.levels).select("_group", "root") for b in found))


def proven(found: list[DataFrame], above: DataFrame, settings: Settings) -> DataFrame:
    """(_group, _rank, item, digest, path, above) of the rows of the first round.

    above has (_group, path, above): the siblings above a group's root, and a value that all of its rows get. Blocks of a round meet
    what stands above them before their rows come out, so only rows of blocks are joined, never rows of documents.
    """
    size, proofs = ARITY**settings.levels, None
    kind = dict(above.dtypes)["above"]
    for level in reversed(range(len(found))):
        last = above.select(F.col("_group").alias("_of"), F.lit(0).cast("long").alias("_at"), "path", "above")
        top = found[level].where(F.col("_total") <= size)
        joined = top.join(last, (F.col("_group") == F.col("_of")) & (F.col("_block") == F.col("_at")))
        if proofs is not None:
            below = found[level].where(F.col("_total") > size)
            joined = joined.unionByName(below.join(proofs.select(F.col("_group").alias("_of"), F.col("_rank").alias("_at"), "path", "above"), (F.col("_group") == F.col("_of")) & (F.col("_block") == F.col("_at"))))
        item = dict(found[level].dtypes)["items"][len("array<") : -1]
        proofs = joined.select("_group", "_block", "_total", "items", "nodes", "n", "path", "above").mapInArrow(_prover(settings), f"_group string, _rank long, item {item}, digest string, path {PATH}, above {kind}")
        if level:
            proofs = stored(proofs.drop("item"), "merkle-paths").withColumn("item", F.lit(None))
    return proofs


def _prover(settings: Settings):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: batch.column(name)[k] for name in batch.schema.names if name != "items"}
                n, block = one["n"].as_py(), one["_block"].as_py()
                levels = block_levels(n, one["_total"].as_py(), settings.levels)
                nodes = np.frombuffer(one["nodes"].as_py(), np.uint8).reshape(-1, _DIGEST)
                higher = [(s["left"], s["right"]) for s in one["path"].as_py()]
                found = [[{"left": a, "right": b} for a, b in [*own, *higher]] for own in paths(nodes, levels, n)]
                leaves = [nodes[a].tobytes().hex() for a in addresses(levels)[-1][:n]]
                start = block * ARITY**settings.levels
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["_group"].as_py()] * n, pa.string()), pa.array(range(start, start + n), pa.int64()), batch.column("items").slice(k, 1).flatten(), pa.array(leaves, pa.string()), pa.array(found, step), pa.array([one["above"].as_py()] * n, batch.schema.field("above").type)],
                    names=["_group", "_rank", "item", "digest", "path", "above"],
                )

    return prove


def proofs(rows: DataFrame, order: list[str], settings: Settings = Settings()) -> DataFrame:
    """(item, digest, subroot, root, path) of rows (_group, digest, item and the columns of order).

    _group is a string; groups are ordered by it, bytewise, and rows within it by order, null first.
    """
    sorted_rows = ranked(rows, order, "merkle-leaves")
    most = sorted_rows.agg(F.max("_total")).first()[0] or 0
    found = rounds(sorted_rows.select("_group", "_rank", "_total", "digest", "item"), most, settings)
    subroots = stored(tops(found, settings).select(F.lit("").alias("_group"), F.col("_group").alias("of"), F.col("root").alias("digest")), "merkle-subroots")
    over = ranked(subroots.withColumn("item", F.struct(F.col("of").alias("of"), F.col("digest").alias("subroot"))), ["of"], "merkle-groups")
    groups = over.agg(F.max("_total")).first()[0] or 0
    upper = rounds(over.select("_group", "_rank", "_total", "digest", "item"), groups, settings)
    nothing = F.array().cast(PATH)
    top = tops(upper, settings).select("_group", nothing.alias("path"), F.col("root").alias("above"))
    above = proven(upper, top, settings).select(F.col("item.of").alias("_group"), "path", F.struct(F.col("item.subroot").alias("subroot"), F.col("above").alias("root")).alias("above"))
    return proven(found, stored(above, "merkle-above"), settings).select("item", "digest", F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root"), "path")


def group_key(value: Column) -> Column:
    """A string for a group: null is before every value, the empty one too."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


@tidy
def manifest(docs: DataFrame, columns: list[str], group: str, key: str, claimed: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """Per row: key, group, leaf, subroot (of its group), root, path (its siblings, from its own level up), claimed.

    A leaf is the digest of columns. claimed is a digest to check against the tree, the leaf itself where none is given; folded(claimed, path) is root
    if and only if nothing has changed. Rows of one group are ordered by key and then by leaf, so rows that repeat a key have
    defined places, and rows that are equal in all columns have equal leaves at neighbouring places. Null keys come first, null groups are a
    group; null values and empty texts differ. Very long texts are hashed on the JVM as they are; other columns aren't
    looked at. An empty table gives no rows.
    """
    own = leaf(*(F.col(c) for c in columns))
    slim = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed"))
    rows = stored(slim, "merkle-rows").select(group_key(F.col("group")).alias("_group"), "digest", F.struct("key", "group", "claimed").alias("item"), "key")
    found = proofs(rows, ["key", "digest"], settings)
    return found.select(F.col("item.key").alias("key"), F.col("item.group").alias("group"), F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("item.claimed").alias("claimed"))


#: What a leaf of documents holds, in this order.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(docs_leaf: Column, doc_id: Column, values: list[Column]) -> Column:
    """The leaf after a change of the rows whose id's checksum 3 divides: A-Z of the text are lower-cased."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, leaf(*values[:-1], ascii_lower(values[-1]))).otherwise(docs_leaf)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by lang, every row's proof, and whether it still holds after the change of some texts.

    Rows of odd input follow manifest(); a null doc_id isn't changed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT)
    values = [F.col(c) for c in DOCUMENT]
    found = manifest(docs, DOCUMENT, "lang", "doc_id", tampered(leaf(*values), F.col("doc_id"), values))
    again = folded(F.col("claimed"), F.col("path"))
    out = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 1) AS crc
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) END AS changed FROM d
), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM l),
tree AS (
  SELECT 0 AS level, lang, ix, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL
  SELECT level + 1, lang, ix // 8, sha256(string_agg(h, '' ORDER BY ix)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY level, lang, ix // 8
), sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS ix FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, ix, h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, ix // 8, sha256(string_agg(h, '' ORDER BY ix)), (any_value(n) + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, ix // 8
), step AS (
  SELECT a.level, a.lang, a.ix, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix < a.ix), '') AS lhs, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix > a.ix), '') AS rhs
  FROM tree a JOIN tree b ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.ix // 8 = b.ix // 8 WHERE a.n > 1 GROUP BY a.level, a.lang, a.ix
), crown_step AS (
  SELECT a.level, a.ix, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix < a.ix), '') AS lhs, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix > a.ix), '') AS rhs
  FROM crown a JOIN crown b ON a.level = b.level AND a.ix // 8 = b.ix // 8 WHERE a.n > 1 GROUP BY a.level, a.ix
), lower_path AS (
  SELECT p.lang, p.ix, list({'l': s.lhs, 'h': '', 'r': s.rhs} ORDER BY s.level) AS steps
  FROM p JOIN step s ON s.lang IS NOT DISTINCT FROM p.lang AND s.ix = p.ix // (8 ** s.level)::BIGINT GROUP BY p.lang, p.ix
), upper_path AS (
  SELECT sub.lang, list({'l': s.lhs, 'h': '', 'r': s.rhs} ORDER BY s.level) AS steps FROM sub JOIN crown_step s ON s.ix = sub.ix // (8 ** s.level)::BIGINT GROUP BY sub.lang
), f AS (
  SELECT p.doc_id, p.leaf, sub.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, list_concat(coalesce(lo.steps, []), coalesce(up.steps, [])) AS steps, coalesce(p.changed, p.leaf) AS claimed
  FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN lower_path lo ON lo.lang IS NOT DISTINCT FROM p.lang AND lo.ix = p.ix LEFT JOIN upper_path up ON up.lang IS NOT DISTINCT FROM p.lang
), g AS (
  SELECT *, list_reduce(list_prepend({'l': '', 'h': claimed, 'r': ''}, steps), lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}).h AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
