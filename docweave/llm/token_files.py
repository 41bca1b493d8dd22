"""Token ids in word-aligned binary files: Simple-8b with escapes, blocks, and a footer with their offsets.

A file holds the ids of its documents one after another, in blocks of BLOCK ids (the last has fewer). A block is a run of
64-bit little-endian words: the top four bits are a selector, the other sixty hold as many ids of one width as the selector says.
An id of more than sixty bits is an escape: its word names a place in the raw 64-bit words that follow the block's own. A block starts
anew, so any range of ids is decoded from the blocks that it touches, all words of a selector at once. The footer has offset, ids, words
and escapes of each block, and id and number of tokens of each document.
"""

from __future__ import annotations

import functools
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import new_path, remove, stored, tidy

# Fixed values: (ids a word, bits an id) by selector. 0 is an escape, 1 a run of zeros.
SELECTORS = ((1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = b"DWTOKEN1"
BLOCK = 1024
#: Blocks that are packed or decoded at once.
TOGETHER = 1024

_COUNTS = np.array([n for n, _ in SELECTORS])
_FOOT = np.dtype([("offset", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
_TAIL = np.dtype([("blocks", "<u8"), ("docs", "<u8")])
_TOO_WIDE = 255


# Words.


@functools.cache
def _short_bits() -> np.ndarray:
    """How many bits each number below 2 ** 16 needs."""
    return np.concatenate([np.zeros(1, np.uint8), *(np.full(1 << k, k + 1, np.uint8) for k in range(16))])


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each id needs."""
    out, left = np.zeros(ids.shape, np.uint8), ids
    while left.max(initial=0) >> 16:
        out += np.where(left >> np.uint64(16), np.uint8(16), np.uint8(0))
        left = np.where(left >> np.uint64(16), left >> np.uint64(16), left)
    return out + _short_bits()[left]


def _choices(bits: np.ndarray) -> np.ndarray:
    """The selector with the most ids for a word that starts at each place; rows are blocks, places after their end are _TOO_WIDE."""
    widest, span = {1: bits}, 1
    while 2 * span <= max(_COUNTS):
        widest[2 * span] = _moved_max(widest[span], span)
        span *= 2
    out = np.zeros(bits.shape, np.uint8)
    for selector in range(len(SELECTORS) - 1, 0, -1):
        n, width = SELECTORS[selector]
        span = 1 << (n.bit_length() - 1)
        np.copyto(out, np.uint8(selector), where=_moved_max(widest[span], n - span) <= width)
    return out


def _moved_max(values: np.ndarray, by: int) -> np.ndarray:
    """The larger of each value and the one so many places on in its row."""
    if not by:
        return values
    out = np.full(values.shape, _TOO_WIDE, np.uint8)
    if by < values.shape[1]:
        np.maximum(values[:, :-by], values[:, by:], out=out[:, :-by])
    return out


def packed(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of some ids, and their rows of the footer with offsets from 0. Blocks are walked side by side, a word of each at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    bits = np.full(blocks * BLOCK, _TOO_WIDE, np.uint8)
    bits[: len(ids)] = _bits(ids)
    choice = _choices(bits.reshape(blocks, BLOCK)).ravel()
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, len(ids))
    at, of, starts, owners = np.arange(blocks) * BLOCK, np.arange(blocks), [], []
    while len(at):
        starts.append(at)
        owners.append(of)
        at = at + _COUNTS[choice[at]]
        going = at < end[of]
        at, of = at[going], of[going]
    start = np.concatenate([np.zeros(0, np.int64), *starts])
    order = np.argsort(start, kind="stable")
    start, owner = start[order], np.concatenate([np.zeros(0, np.int64), *owners])[order]
    selector = choice[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        where, (n, width) = np.flatnonzero(selector == s), SELECTORS[s]
        if width:
            parts = ids[start[where][:, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * np.uint64(width))
            words[where] |= np.bitwise_or.reduce(parts, axis=1)
    escaped = np.flatnonzero(selector == 0)
    escapes = np.bincount(owner[escaped], minlength=blocks)
    foot = np.zeros(blocks, _FOOT)
    foot["ids"], foot["words"], foot["escapes"] = end - np.arange(blocks) * BLOCK, np.bincount(owner, minlength=blocks), escapes
    first = np.cumsum(escapes) - escapes
    words[escaped] |= (np.arange(len(escaped)) - first[owner[escaped]]).astype(np.uint64)
    sizes = foot["words"].astype(np.int64) + foot["escapes"]
    foot["offset"] = (np.cumsum(sizes) - sizes) * 8
    if len(escaped):  # a block's escapes follow its own words
        words = np.insert(words, np.cumsum(foot["words"].astype(np.int64))[owner[escaped]], ids[start[escaped]])
    return words.astype("<u8").tobytes(), foot


def unpacked(data: bytes, foot: np.ndarray) -> np.ndarray:
    """The ids of neighbouring blocks, from their bytes and their rows of the footer."""
    words = np.frombuffer(data, "<u8")
    raw, own = np.zeros(0, np.uint64), foot["words"].astype(np.int64)
    if foot["escapes"].any():
        sizes = np.stack([own, foot["escapes"].astype(np.int64)], axis=1).ravel()
        escape = np.repeat(np.tile([False, True], len(foot)), sizes)
        words, raw = words[~escape], words[escape]
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNTS[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        where, (n, width) = np.flatnonzero(selector == s), SELECTORS[s]
        if width:
            parts = (words[where][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            out[at[where][:, None] + np.arange(n)] = parts
        elif not s:
            block = np.searchsorted(np.cumsum(own), where, side="right")
            base = np.cumsum(foot["escapes"].astype(np.int64)) - foot["escapes"]
            out[at[where]] = raw[base[block] + (words[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


# Files.


class Writer:
    """One file: documents in the order of add(), then close()."""

    def __init__(self, out) -> None:
        self._out, self._offset, self._held, self._n = out, len(MAGIC), [], 0
        self._foot: list[np.ndarray] = []
        self._docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(ids)))
        self._held.append(ids)
        self._n += len(ids)
        if self._n >= BLOCK * TOGETHER:
            self._flush(self._n // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._held)
        for k in range(0, n, BLOCK * TOGETHER):
            data, foot = packed(ids[k : min(n, k + BLOCK * TOGETHER)])
            foot["offset"] += self._offset
            self._out.write(data)
            self._foot.append(foot)
            self._offset += len(data)
        self._held, self._n = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self._n:
            self._flush(self._n)
        foot, docs = np.concatenate([np.zeros(0, _FOOT), *self._foot]), np.array(self._docs, _DOCS)
        self._out.write(foot.tobytes() + docs.tobytes() + np.array((len(foot), len(docs)), _TAIL).tobytes() + MAGIC)


class Reader:
    """Random access to a file, from an open seekable stream and its size."""

    def __init__(self, source, size: int) -> None:
        self._source, ends = source, _TAIL.itemsize + len(MAGIC)
        tail = self._read(size - ends, ends)
        if tail[_TAIL.itemsize :] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file, or not a whole one")
        blocks, docs = (int(x) for x in np.frombuffer(tail[: _TAIL.itemsize], _TAIL)[0])
        foot = self._read(size - ends - docs * _DOCS.itemsize - blocks * _FOOT.itemsize, docs * _DOCS.itemsize + blocks * _FOOT.itemsize)
        self.blocks, self.docs = np.frombuffer(foot, _FOOT, blocks), np.frombuffer(foot, _DOCS, docs, blocks * _FOOT.itemsize)

    def _read(self, at: int, n: int) -> bytes:
        self._source.seek(at)
        return self._source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, counted over the whole file."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // BLOCK, -(-stop // BLOCK)
        foot = self.blocks[first:last]
        begin, end = int(foot["offset"][0]), int(foot["offset"][-1]) + 8 * (int(foot["words"][-1]) + int(foot["escapes"][-1]))
        return unpacked(self._read(begin, end - begin), foot)[start - first * BLOCK : stop - first * BLOCK]


# Texts to ids.

#: A space before something else than white space: the tokenizer's own cut of a text always falls here, so both sides can be encoded apart.
_CUT = re.compile(r" (?=\S)")
_SLICE = 1 << 20
#: Marks that are a piece of their own after a letter, and the first character beyond the Latin letters.
_MARKS, _LATIN = ".,;:!?", "ɐ"


class _Uneven(Exception):
    """A word that is empty or begins with white space."""


class _Words(dict):
    """The ids of words that stand after a space, as bytes; those of words not met yet come from the tokenizer. At most ``most`` are kept."""

    def __init__(self, of: Encoder, most: int) -> None:
        self._of, self._most = of, most

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Uneven
        if len(self) >= self._most:
            self.clear()
        self[word] = ids = self._of.part(" " + word)
        return ids


class Encoder:
    """A tokenizer of the byte-level kind that keeps the ids of words that it has met.

    Words are what single spaces part; the ids of a text are those of its words one after another. A word is cut by the tokenizer's own rules and
    goes to its model; one that may hold an added token, and every one where the tokenizer changes texts first, goes through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = tokenizer = Tokenizer.from_file(path)
        self._cut, self._model, self._end = tokenizer.pre_tokenizer, tokenizer.model, array("I", [end_id]).tobytes()
        self._added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._by_parts = tokenizer.normalizer is None and isinstance(self._cut, ByteLevel) and self._cut.use_regex and not self._cut.add_prefix_space
        whole = ByteLevel(add_prefix_space=False, use_regex=False)
        self._signs = {c: whole.pre_tokenize_str(chr(c))[0][0] for c in (0x20, *range(0x80, 0x250))}
        self._words, self._pieces, self._most = _Words(self, most), {}, most
        self._mark = {m: array("I", tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in _MARKS}

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the tokenizer has cut, in its own letters for bytes."""
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of a part of a text that begins and ends where the tokenizer cuts."""
        if not self._by_parts or any(a in text for a in self._added):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text[:1] == " " and max(text) < _LATIN:  # most often letters, which are one piece, or those and a mark, which are two
            if text[1:].isalpha():
                return self._piece(text.translate(self._signs))
            if text[-1] in _MARKS and text[1:-1].isalpha():
                return self._words[text[1:-1]] + self._mark[text[-1]]
        out = []
        for piece, _ in self._cut.pre_tokenize_str(text):
            if (ids := self._pieces.get(piece)) is None:
                if len(self._pieces) >= self._most // 10:
                    self._pieces.clear()
                self._pieces[piece] = ids = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def _slices(self, text: str) -> Iterator[str]:
        """The text in pieces of about _SLICE characters that can be encoded apart."""
        at = 0
        while len(text) - at > _SLICE and (cut := _CUT.search(text, at + _SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _learn(self, words: set[str]) -> None:
        """Ids of words not met yet, those of letters in one go."""
        if len(self._words) + len(words) > self._most:
            self._words.clear()
        keep, tokenize, space, signs = self._words, self._model.tokenize, self._signs[0x20], self._signs
        for word in words:
            if self._by_parts and word.isalpha() and max(word) < _LATIN and not any(a in word for a in self._added):
                keep[word] = array("I", [t.id for t in tokenize(space + (word if word.isascii() else word.translate(signs)))]).tobytes()
            else:
                keep[word] = self.part(" " + word)

    def _uneven(self, text: str) -> bytes:
        """Ids of a text in which more than single spaces part words: it is cut elsewhere."""
        cuts = [0, *(m.start() for m in _CUT.finditer(text, 1)), len(text)]
        return self.part(text[: cuts[1]]) + b"".join(self._words[text[a + 1 : b]] for a, b in zip(cuts[1:], cuts[2:]))

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. All words are looked up, then those that are missing are learnt together, and then put in their places."""
        met, missing, seen = self._words.get, set(), []
        for text in texts:
            first, *words = text.split(" ")
            found = list(map(met, words))
            gaps = [k for k, ids in enumerate(found) if ids is None] if None in found else []
            new = {words[k] for k in gaps}
            even = "" not in new and not any(w[0].isspace() for w in new)
            if even:
                missing |= new
            seen.append((first, words, found, gaps) if even else None)
        self._learn(missing)
        out, get = [], self._words.__getitem__
        for text, one in zip(texts, seen):
            if one is None:
                out.append(self._uneven(text))
                continue
            first, words, found, gaps = one
            for k in gaps:
                found[k] = get(words[k])
            out.append((self.part(first) if first else b"") + b"".join(found))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts (null: of the empty one), each with the end id."""
        slices = [[piece for piece in self._slices(text or "") if piece] for text in texts]
        ids = iter(self._ids([piece for own in slices for piece in own]))
        return [np.frombuffer(b"".join([*(next(ids) for _ in own), self._end]), "<u4") for own in slices]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    """One in each Python worker, whatever tasks it runs."""
    return Encoder(path, end_id)


# Jobs.


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: a file of the tokenizers library that all executors have; ``end_id`` ends each document."""

    tokenizer: str
    end_id: int = 2


INDEX = "part int, file string, n_docs long, n_ids long"


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some hundred texts, or fewer where they are long."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        end = min(start + 256, max(start + 1, int(np.searchsorted(sizes, before + _SLICE, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def _writer(folder: str, settings: Settings) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.FileSystem.from_uri(folder)
        encoder, name = _encoder(settings.tokenizer, settings.end_id), f"{uuid.uuid4().hex}.s8b"
        out, file, docs, ids = None, None, 0, 0
        try:
            for batch in batches:
                for rows in _few(batch):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        file = Writer(out)
                    for doc_id, found in zip(rows.column(0).to_pylist(), encoder.encode_all(rows.column(1).to_pylist())):
                        file.add(doc_id, found)
                        docs, ids = docs + 1, ids + len(found)
            if file is not None:
                file.close()
        finally:
            if out is not None:
                out.close()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    return write


def write_ids(docs: DataFrame, folder: str, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents below folder (a URI that all executors reach), ascending by doc_id over the files; returns the stored index.

    The index (part, file, n_docs, n_ids, base: ids in the files before) has a row for each file. Only files that it names count: a task
    that ran twice leaves a file that nothing names.
    """
    order = ["doc_id", "_tie"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_tie"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    index = stored(sorted_rows.mapInArrow(_writer(folder, settings), INDEX), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return index.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            store, path = files.FileSystem.from_uri(uri)
            with store.open_input_file(path) as source:
                file = Reader(source, source.size())
                ends = np.cumsum(file.docs["tokens"]).astype(np.int64)
                k = 0
                while k < len(ends):  # as many documents as TOGETHER blocks hold, one at least
                    start = int(ends[k - 1]) if k else 0
                    to = max(k + 1, int(np.searchsorted(ends, start + BLOCK * TOGETHER, side="right")))
                    ids = file.ids(start, int(ends[to - 1])).astype("<u4").tobytes()
                    cuts = [start, *ends[k:to].tolist()]
                    docs = file.docs[k:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs["doc_id"], pa.int64(), mask=docs["null"].astype(bool)), pa.array([base + c for c in cuts[:-1]], pa.int64()), pa.array([ids[4 * (a - start) : 4 * (b - start)] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )
                    k = to


def read_ids(index: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents in the files of write_ids()' index, or of some of its rows; ids are little-endian unsigned 32-bit integers."""
    return index.select("file", "base").repartition(max(1, index.count())).mapInArrow(_reader, "doc_id long, start long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@tidy
def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """Encode all documents, write their ids in ascending order of doc_id, read the files back and report each document's place, length and checksum.

    Null and empty texts are the end id alone. Null ids come first; rows of one id are ordered by a hash of their text, and rows that are equal in
    both stand in any order, which no column shows. Text that looks like the tokenizer's special token becomes that token, as
    the library does by default. A very long text is encoded in pieces between which the tokenizer always cuts, and one document is held as a whole by a task. Other columns
    aren't looked at. An empty table gives no files and no rows.
    """
    folder = new_path(spark, "tokens")
    index = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, Settings(default_tokenizer()))
    out = stored(read_ids(index).select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "token-rows")
    remove(spark, folder)
    return out
