"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with one shingle set are one node. Banded MinHash signatures give candidate pairs; signatures are compared in
batches, and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls below
the chosen miss probability. What survives is verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.components import components
from docweave.llm.shared import row_key, stored, tidy


@dataclass(frozen=True)
class Settings:
    """32 bands of 4 miss a pair of similarity 0.75 with a probability of 0.0000052.

    miss is the posterior probability below which a pair is dropped after a batch, under a uniform prior.
    """

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6
    seed: int = 1


_WORD_HASHES: dict[bytes, int] = {}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text.

    bytes.lower() and bytes.split() change and split at ASCII characters only, as the contract asks.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = _WORD_HASHES
    if len(known) > 400_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        out = _spread(out * _MIX[0] + ids[k : k + n])
    return np.unique(out)


@cache
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, np.uint64)


def minhash(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n 32-bit minima of the set under multiply-add permutations, a block of shingles at a time."""
    a, b = _permutations(n, seed)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        block = hashes[at : at + 256, None] * a
        block += b
        np.minimum(low, block.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signer(settings: Settings):
    """Batches of (doc_id, text, key) to set sizes, set fingerprints and signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, sigs = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), settings.width)
                sizes.append(len(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sigs.append(minhash(h, settings.bands * settings.rows, settings.seed).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "key", "n_shingles", "set_id", "sig"])

    return sign


def bucket_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """Signatures (n, bands * rows) to one 64-bit key for each band (n, bands)."""
    parts = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        keys = _spread(keys * _MIX[0] + parts[:, :, k])
    return keys


def _bucket_rows(keys: np.ndarray, nodes: pa.Array) -> pa.RecordBatch:
    ids = np.repeat(nodes.to_numpy(zero_copy_only=False), keys.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids, pa.int64())], names=["bucket", "node"])


def bander(settings: Settings):
    """Batches of (node, sig) to rows (bucket, node)."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                yield _bucket_rows(bucket_keys(sigs, settings.bands), batch.column(0))

    return band


def lister(settings: Settings):
    """Batches of (node, text) to rows (node, n, shingle)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                h = shingle_hashes(text.as_py(), settings.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node.as_py(), np.int64)), pa.array(np.full(len(h), len(h), np.int64)), pa.array(h.view(np.int64))], names=["node", "n", "shingle"])

    return rows


@cache
def least_matches(settings: Settings) -> tuple[int, ...]:
    """Per batch, the fewest equal hashes so far with which a pair stays.

    With a uniform prior and m of n equal, P(similarity >= t) is the probability of at most m successes in n + 1 trials of chance t.
    """
    t, out = settings.percent / 100, []
    for n in range(settings.batch, settings.bands * settings.rows + 1, settings.batch):
        total, m = (1 - t) ** (n + 1), 0
        while total < settings.miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def pruner(settings: Settings):
    """Batches of (a, b, signature, signature) to the pairs that stay."""
    least = least_matches(settings)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, need in enumerate(least):
                cut = slice(k * settings.batch, (k + 1) * settings.batch)
                equal[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[equal[alive] >= need]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return prune


def verifier(settings: Settings):
    """Batches of (a, b, text, text) to the pairs that are links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # pairs with one b come one after another
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                b, other = batch.column(1)[k].as_py(), batch.column(3)[k].as_py()
                if last[0] != (b, other):
                    last = ((b, other), shingle_hashes(other, settings.width))
                mine = shingle_hashes(batch.column(2)[k].as_py(), settings.width)
                both = len(np.intersect1d(mine, last[1], assume_unique=True))
                if both and 100 * both >= settings.percent * (len(mine) + len(last[1]) - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return verify


class NearDuplicates:
    """The steps of one run. Each table is stored in the shared folder, so a lost executor costs its tasks only."""

    def __init__(self, docs: DataFrame, settings: Settings, doc_id: str, text: str) -> None:
        self.settings, self.spark = settings, docs.sparkSession
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        keyed = self.docs.withColumn("key", row_key("doc_id", "text"))
        signed = keyed.mapInArrow(signer(settings), "doc_id long, key long, n_shingles long, set_id binary, sig binary")
        self.signed = stored(signed, "signed")
        # Equal sets are one node, named by their smallest id.
        self.nodes = stored(
            self.signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig")),
            "nodes",
        )
        rows = self.nodes.select("node", "sig").mapInArrow(bander(settings), "bucket long, node long")
        shared = rows.groupBy("bucket").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).where("_low <> _high").select("bucket")
        self.members = stored(rows.join(shared, "bucket"), "members")
        active = self.members.select(F.col("node").alias("_n")).distinct()
        self.texts = stored(self.docs.join(active, F.col("doc_id") == F.col("_n"), "left_semi"), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that are links."""
        sig = self.nodes.select("node", "sig")
        one = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("_sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("_sb")), "b")
        likely = stored(one.select("a", "b", "_sa", "_sb").mapInArrow(pruner(self.settings), "a long, b long"), "likely")
        with_a = likely.join(self.texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a")
        with_b = with_a.join(self.texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b")
        return stored(with_b.select("a", "b", "_ta", "_tb").mapInArrow(verifier(self.settings), "a long, b long"), "verified").distinct()

    def unsettled(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (bucket, node, comp) of the buckets whose nodes are not one component yet."""
        rows = rows.join(labels, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
        split = rows.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("bucket")
        return stored(rows.join(split, "bucket"), "unsettled")

    @staticmethod
    def stars(rows: DataFrame) -> DataFrame:
        """Each row of a bucket with the bucket's smallest node, where the components differ."""
        hubs = rows.groupBy("bucket").agg(F.min(F.struct("node", "comp")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp"))
        return rows.join(hubs, "bucket").where("comp <> hub_comp").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    def rest(self, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that share a bucket and may be similar enough: an exact prefix-filter join.

        The shingles of each set are ordered from rare to common. Two sets of n and m shingles can only be similar enough with
        ``need`` shingles in common, so with one in common among the first n - need + 1 of one and the first m - need + 1 of
        the other. Common passages come last in the order and meet nobody. A shingle's largest component isn't paired with itself.
        """
        percent = self.settings.percent
        nodes = self.unsettled(self.members, labels).select("node", "comp").distinct()
        nodes = stored(nodes.select(F.col("node").alias("_n"), "comp"), "unsettled-nodes")
        texts = self.texts.join(nodes, F.col("doc_id") == F.col("_n"), "left_semi")
        shingles = stored(texts.mapInArrow(lister(self.settings), "node long, n long, shingle long"), "shingles")
        # Stored, the counts meet the shingles in a join whose hot keys Spark can split.
        counts = stored(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle-counts")
        order = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
        ranked = shingles.join(counts, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        first = ranked.withColumn("at", order).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1")
        first = stored(first.join(nodes, F.col("node") == F.col("_n")).select("shingle", "node", "n", "at", "comp"), "prefixes")
        sizes = first.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
        most = stored(sizes.where("comps > 1").select("shingle", F.col("most.comp").alias("_most")), "largest-components")
        minor = first.join(most, "shingle").where("comp <> _most")
        minor = stored(minor.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("comp").alias("_comp")), "minor-prefixes")
        need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
        fits = (F.col("comp") != F.col("_comp")) & (F.col("at") <= F.col("n") - need + 1) & (F.col("bt") <= F.col("m") - need + 1)
        return first.join(minor, (first["shingle"] == minor["shingle"]) & fits).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()

    def labels(self) -> DataFrame:
        """(node, comp) of all nodes with a link.

        First every node meets the smallest node of each of its buckets, so a large group grows together in a number of
        pairs linear in its size. What shares a bucket with another component after that (documents that hold a common passage, or
        resemble other members only) goes through rest(). No pair is left out by a cap.
        """
        met = stored(self.stars(self.members.withColumn("comp", F.col("node"))), "pairs")
        links = self.verified(met)
        labels = components(links)
        more = stored(self.rest(labels).join(met, ["a", "b"], "left_anti"), "pairs")
        return components(links.union(self.verified(more)))


def _judged(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """Per document: doc_id, key (of id and text), n_shingles, component_id, kept."""
    run = NearDuplicates(docs, settings, doc_id, text)
    named = run.nodes.select("set_id", "node").join(run.labels(), "node", "left").select("set_id", F.coalesce("comp", "node").alias("comp"))
    component = F.coalesce("comp", "doc_id")
    rows = run.signed.select("doc_id", "key", "n_shingles", "set_id").join(named, "set_id", "left")
    return rows.select("doc_id", "key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


@tidy
def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id that links reach), kept.

    Ids are taken to be unique; repeated rows are copies of one document and all of them carry its result. Documents without words
    (null texts too) link with nothing. A document with a null id keeps its own row, joins the component of its equal set, if
    any, and is kept where there is none. Very long texts are hashed whole. Other columns aren't looked at. An empty table gives no rows.
    """
    return _judged(docs, settings, doc_id, text).drop("key")


@tidy
def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each component: the document with its smallest id.

    Of rows that repeat this id, one stays (of different texts under one id, one whose text is its own component). Rows of null ids stay where they have no component, once for
    each text. Documents without words stay, once for each id.
    """
    kept = _judged(docs, settings, "doc_id", "text").where("kept")
    kept = kept.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("key")).alias("_of")).agg(F.min("key").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    kept = stored(kept.select(F.col("doc_id").alias("__neardup_id"), F.col("_least").alias("__neardup_key"), F.col("_rows").alias("__neardup_rows")), "kept-ids")
    key = row_key(F.col("doc_id").cast("long"), F.col("text"))

    def rows_of(ids: DataFrame) -> DataFrame:
        return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__neardup_id")) & (key == F.col("__neardup_key")), "left_semi")

    # Rows travel by id only; those of repeated ids, as a rule few, are then told apart.
    again = stored(kept.where("__neardup_rows > 1"), "repeated-ids")
    repeated = rows_of(again).withColumn("__neardup_key", key).dropDuplicates(["doc_id", "__neardup_key"]).drop("__neardup_key")
    return rows_of(kept.where("__neardup_rows = 1")).unionByName(repeated)


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
