"""Repeated-passage removal: a depth-limited radix sort of suffixes that keeps equal groups only.

Tokens are bytes or words, and the depth is the threshold length. No suffix is ordered beyond it, and groups of one are dropped
after each pass:

1. Every window (suffix of threshold length) belongs to the string of ``anchor`` tokens of least hash within it, which is
   the same in every copy of the window. Consecutive windows with one anchor are a piece. Pieces are grouped by anchor, and equal
   pieces under an anchor become one with a number of copies. Hashes serve here: one of 64 bits to drop anchors that no
   other piece has (which can't lose anything) and another, together with it, to merge equal pieces.
2. What is left, pieces that share an anchor but differ, is ordered by its bytes. Up to ``run`` neighbouring suffixes travel
   together as long as passes look at the tokens that all of them have (the core): passes go from the most significant byte group to
   the least, and split groups by the next ``DIGIT`` bytes.
3. Of runs with one core, those that are equal as a whole are repeated. The others, the ends of repeated passages, are split into their
   suffixes, and the last pass groups these by the few bytes outside the core.

Equal groups after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import release, row_key, stored, tidy

#: Bytes that a pass looks at; the last of the PASSES looks at all that is left of a core.
DIGIT = 128
PASSES = 3


@dataclass(frozen=True)
class Settings:
    """Windows of ``length`` tokens are repeated or not. Tokens are bytes, or words between ASCII white space."""

    length: int = 400
    anchor: int = 100
    run: int = 32
    words: bool = False


#: Passages of 50 words.
PASSAGES = Settings(50, 12, 8, True)

_CHUNK = 1 << 18  # tokens that are hashed at once
_POSITION = np.uint64((1 << 28) - 1)
_DRAW = np.random.default_rng(11)
_BYTES = [_DRAW.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(b) | 1 for b in _DRAW.integers(2**40, 2**62, 2)]
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse (modulo 2**64), at least n of them."""
    if len(_powers[which][0]) < n:
        size = 1 << n.bit_length()
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = (out[0], out[1])
    return _powers[which]


class Hashes:
    """Polynomial hashes of any substring of a string of tokens, which are given as 64-bit values."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        up, self._down = _of(which, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scatter((self._sums[end] - self._sums[start]) * self._down[start])

    def every(self, width: int) -> np.ndarray:
        """The hash at each position."""
        n = len(self._sums) - width
        return _scatter((self._sums[width:] - self._sums[:n]) * self._down[:n])


def least_at(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key (the leftmost of equals) in each window of ``width`` keys."""
    n = len(keys)
    ranks = (keys & ~_POSITION) | np.arange(n, dtype=np.uint64)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = ranks
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (low & _POSITION).astype(np.int64)


def tokens_of(codes: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Two values for each token of the texts in codes (bytes), and where each text's tokens start; offsets are the texts' bytes."""
    values = [table[codes] for table in _BYTES]
    if not words:
        return values, offsets
    inside = ~_SPACES[codes]
    before, after = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[1:-1][offsets[1:-1] < len(codes)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return [Hashes(v, k)(starts, ends) for k, v in enumerate(values)], np.searchsorted(starts, offsets)


def pieces(values: list[np.ndarray], offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...] | None:
    """(text, anchor hash, piece hash, first window, last window, anchor position) of each piece; None if all texts are too short."""
    lens = np.maximum(np.diff(offsets) - settings.length + 1, 0)
    if not lens.any():
        return None
    text = np.repeat(np.arange(len(lens)), lens)
    at = np.repeat(offsets[:-1] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())  # all windows within a text
    anchors = Hashes(values[0], 0).every(settings.anchor)
    place = least_at(anchors, settings.length - settings.anchor + 1)[at]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
    text, place, first, last = text[first], place[first], at[first], at[last]
    whole = Hashes(values[1], 1)(first, last + settings.length)
    start = offsets[text]
    return text, _scatter(anchors[place] + np.uint64(settings.words)), _scatter(whole + (place - first).astype(np.uint64)), first - start, last - start, place - start


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together; a long text is a range of its own."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and total + n > _CHUNK:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def pieces_of(codes: np.ndarray, offsets: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """pieces() of texts; one very long text goes in overlapping sections, whose windows don't overlap."""
    values, starts = tokens_of(codes, offsets, settings.words)
    n = int(starts[-1])
    if len(offsets) > 2 or n <= 2 * _CHUNK:
        found = pieces(values, starts, settings)
        if found is not None:
            yield found
        return
    for a in range(0, n - settings.length + 1, _CHUNK):
        b = min(n, a + _CHUNK + settings.length - 1)
        found = pieces([v[a:b] for v in values], np.array([0, b - a]), settings)
        if found is not None:
            yield *found[:3], *(x + a for x in found[3:])


_PIECE = "words boolean, anchor long, piece long, doc_id long, key long, lo int, hi int, at int"


def cutter(units: tuple[Settings, ...]):
    """Batches of (doc_id, key, bytes) to pieces of each kind of tokens."""
    names = ["words", "anchor", "piece", "doc_id", "key", "lo", "hi", "at"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            codes = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            for first, end in _chunks(np.diff(ends)):
                low = ends[first]
                for unit in units:
                    for text, anchor, piece, lo, hi, at in pieces_of(codes[low : ends[end]], ends[first : end + 1] - low, unit):
                        own = pa.array(text + first)
                        columns = [pa.array(np.full(len(text), unit.words)), *(pa.array(x.view(np.int64)) for x in (anchor, piece)), batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at))]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _slicer(words: bool) -> Callable:
    """Bytes of a range of tokens; words are joined by one space."""
    return (lambda tokens, a, b: b" ".join(tokens[a:b])) if words else (lambda tokens, a, b: tokens[a:b])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_RUN = "words boolean, grp long, level int, core binary, head binary, tail binary, ahead int, span int, lo int, doc_id long, key long, copies long"
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def runner(units: tuple[Settings, ...]):
    """Batches of (doc_id, key, bytes, wanted pieces) to runs: neighbouring windows with the bytes that all of them have (core), those
    before and after it, the distance of the first window to the anchor, and the number of further windows."""
    by = {u.words: u for u in units}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, key, data, wanted = (batch.column(c)[k].as_py() for c in range(4))
                split = data.split() if any(p["words"] for p in wanted) else None
                for p in wanted:
                    unit = by[p["words"]]
                    tokens, part, size, length = split if unit.words else data, _slicer(unit.words), unit.run, unit.length
                    lo, hi, at = p["lo"], p["hi"], p["at"]
                    for level in range((at - hi) // size, (at - lo) // size + 1):
                        most = at - level * size  # windows of a full run: least to most
                        least = most - size + 1
                        first, last = max(least, lo), min(most, hi)
                        yield unit.words, p["anchor"], level, part(tokens, most, least + length), part(tokens, first, most), part(tokens, least + length, last + length), at - first, last - first, first, doc_id, key, p["copies"]

    schema = _schema(_RUN)
    return lambda batches: _batches(rows(batches), schema, lambda r: 80 + len(r[3]) + len(r[4]) + len(r[5]))


_WINDOW = "words boolean, grp long, ahead int, rest binary, doc_id long, key long, lo int, asked boolean"


def exploder(units: tuple[Settings, ...]):
    """Batches of (words, grp, level, head, tail, ahead, span, lo, doc_id, key, asked) to windows: their bytes outside of the core."""
    by = {u.words: u for u in units}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for words, grp, level, head, tail, ahead, span, lo, doc_id, key, asked in zip(*(c.to_pylist() for c in batch.columns)):
                part, most = _slicer(words), (level + 1) * by[words].run - 1
                if words:
                    head, tail = head.split(), tail.split()
                for k in range(span + 1):
                    before, after = part(head, k, len(head)), part(tail, 0, most - ahead + k)
                    yield words, grp, ahead - k, before + b" " + after if words else before + after, doc_id, key, lo + k, asked

    schema = _schema(_WINDOW)
    return lambda batches: _batches(rows(batches), schema, lambda r: 40 + len(r[3]))


def sorted_runs(runs: DataFrame) -> DataFrame:
    """The passes over cores: runs of one grp have one core, and runs alone with theirs are gone.

    Each pass splits the groups by their next bytes and drops groups of one. A group is named by its least run. The groups are stored
    before rows meet them, so Spark can split a hot group in that join.
    """
    by = ["grp", "level", "digit"]
    for k in range(PASSES):
        digit, rest = (F.expr(f"substring(core, 1, {DIGIT})"), F.expr(f"substring(core, {DIGIT + 1})")) if k < PASSES - 1 else (F.col("core"), F.lit(None).cast("binary"))
        rows = runs.withColumn("digit", digit)
        groups = rows.groupBy(*by).agg(F.min("rid").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        groups = stored(groups, "radix-groups")
        kept = [c for c in runs.columns if c not in ("grp", "core")]
        before, runs = runs, stored(rows.join(groups, by).select(F.col("next").alias("grp"), rest.alias("core"), *kept), "radix-runs")
        release(before)
    return runs.drop("core")


def repeated_spans(docs: DataFrame, units: tuple[Settings, ...] = (Settings(),)) -> DataFrame:
    """Spans (words, doc_id, key, lo, end) of tokens within repeated windows. docs has doc_id, key and data (bytes)."""
    length = F.lit(next((u.length for u in units if not u.words), 0))
    for u in units:
        length = F.when(F.col("words") == u.words, F.lit(u.length)).otherwise(length)
    found = stored(docs.mapInArrow(cutter(units), _PIECE), "pieces")
    end = (F.col("hi") + length).alias("end")
    # Anchors of several pieces, and whether these differ. Only longs are grouped, and rows meet the stored result, so a hot anchor can be split.
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("_least"), F.max("piece").alias("_most")).where("n > 1")
    anchors = stored(anchors.select("anchor", (F.col("_least") != F.col("_most")).alias("differ")), "repeated-anchors")
    again = stored(found.join(anchors, "anchor"), "repeated-pieces")
    release(found)
    spans = [again.where("not differ").select("words", "doc_id", "key", "lo", end)]
    open_ = again.where("differ")
    one = F.min(F.struct("doc_id", "key", "lo", "hi", "at", "words")).alias("one")
    equal = stored(open_.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("copies"), one), "equal-pieces")
    whole = equal.where("copies > 1").select("anchor", "piece")
    spans.append(stored(open_.join(whole, ["anchor", "piece"], "left_semi").select("words", "doc_id", "key", "lo", end), "spans"))

    # Pieces of one kind under an anchor of several kinds: one of each, as runs with their bytes.
    # A repeated row brings its runs twice; they are copies already, so nothing changes for them.
    wanted = F.struct("one.words", "anchor", "one.lo", "one.hi", "one.at", "copies")
    lists = equal.groupBy(F.col("one.doc_id").alias("_d"), F.col("one.key").alias("_k")).agg(F.collect_list(wanted).alias("wanted"))  # a text's own pieces
    texts = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", "key", "data", "wanted")
    runs = stored(texts.mapInArrow(runner(units), _RUN).withColumn("rid", F.monotonically_increasing_id()), "runs")
    runs = sorted_runs(runs)

    same = ["grp", "ahead", "span", "head", "tail"]
    owner = [F.min(c).alias(c) for c in ("words", "level", "lo", "doc_id", "key")]  # of the only run, where there is one
    kinds = stored(runs.groupBy(*same).agg(F.sum("copies").alias("all"), *owner), "equal-runs")
    repeated = kinds.where("all > 1").select(*same)
    spans.append(stored(runs.where("copies = 1").join(repeated, same, "left_semi").select("words", "doc_id", "key", "lo", (F.col("lo") + F.col("span") + length).alias("end")), "spans"))

    # Runs that share their core with a different run: window by window. Of equal runs one stands for all.
    several = stored(kinds.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "open-cores")
    asked = (F.col("all") == 1).alias("asked")
    open_ = kinds.join(several, "grp").select("words", "grp", "level", "head", "tail", "ahead", "span", "lo", "doc_id", "key", asked)
    windows = stored(open_.mapInArrow(exploder(units), _WINDOW), "windows")
    last = ["grp", "ahead", "rest"]
    twice = windows.groupBy(*last).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*last)
    hits = windows.where("asked").join(twice, last, "left_semi")
    spans.append(stored(hits.select("words", "doc_id", "key", "lo", (F.col("lo") + length).alias("end")), "spans"))
    return reduce(DataFrame.unionByName, spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the tokens that spans cover."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(end for _, end in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(lo for lo, _ in spans), len(data)]))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def finisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, bytes, spans) to counts, the kept bytes' checksum, the runs removed, and the words in repeated passages."""
    names = [field.split()[0] for field in _RESULT.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            runs, passages = (merged([(s["lo"], s["end"]) for s in spans or () if s["words"] == words]) for words in (False, True))
            removed = sum(end - lo for lo, end in runs)
            kept = kept_bytes(data, runs) if runs else data
            out.append((len(data), removed, len(runs), hashlib.sha256(kept).hexdigest(), sum(end - lo for lo, end in passages)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], names=names)


@tidy
def repeats(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", passages: Settings | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with passages also n_passage_words.

    settings tells which repeated strings of bytes are removed. passages are repeated strings of words: they are counted, not removed.
    Null and empty texts have no bytes. Repeated rows are places of their own, so their texts (of the threshold length or more) are
    removed, and so are all of equal texts (ties). Null ids are allowed; columns besides id and text aren't looked at. An empty table
    gives no rows. Very long texts are hashed in sections and need memory in proportion to their length only where their runs are cut out.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), body.alias("data"))
    spans = repeated_spans(rows, (settings,) if passages is None else (settings, passages))
    lists = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("words", "lo", "end")).alias("spans")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans")
    with_spans = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "data", "spans")
    out = with_spans.mapInArrow(finisher, _RESULT)
    return out if passages is not None else out.drop("n_passage_words")


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a repeated string of 400 bytes, and its words in repeated passages of 50 words."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=PASSAGES)
