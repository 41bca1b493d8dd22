"""License scans: fuzzy search for short notices, by exact seeds and bounded-error matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the contract, and short notices with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "this work is in the public domain": "public-domain",
    "all rights reserved": "reserved",
}
MAX_NOTICES = 10_000
#: Bytes of words; all others become spaces. Letters are lower-cased in the same pass.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """A notice of n characters may have n // chars_per_error errors (insertions, deletions, substitutions)."""

    chars_per_error: int = 10


def word_list(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def places(line: bytes, phrase: str) -> list[int]:
    """Word numbers at which the phrase stands; line is b" word word ... "."""
    needle, out, at, words, seen = f" {phrase} ".encode(), [], line.find(f" {phrase} ".encode()), 0, 0
    while at >= 0:
        words += line.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = line.find(needle, at + 1)
    return out


def matches(pattern: regex.Pattern, line: str, start: int, end: int) -> Iterator[regex.Match]:
    """The best match, then those before and after it: the pattern's own iteration would only go on after the best one."""
    todo = [(start, end)]
    while todo:
        start, end = todo.pop()
        if m := pattern.search(line, start, end):
            yield m
            todo += [(start, m.start()), (m.end(), end)]


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that touch as one; a later seed's window may begin before an earlier one's."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


class Searcher:
    """Finds notices with at most k errors.

    Of k + 1 pieces of a notice, one is free of errors (the pigeonhole principle). An automaton finds all pieces in one pass;
    around each, the regex library looks for the whole notice with bounded errors.
    """

    def __init__(self, settings: Settings, notices: dict[str, str] = NOTICES) -> None:
        self.seeds, self.fuzzy, self.labels = ahocorasick.Automaton(), [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, label) in enumerate(notices.items()):
            errors = len(notice) // settings.chars_per_error
            cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            for start, end in zip(cuts, cuts[1:]):
                pieces.setdefault(notice[start:end], []).append((k, start))
            self.fuzzy.append((regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}(?![^ ])"), len(notice), errors))
            self.labels.append(label)
        for piece, where in pieces.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def search(self, line: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, errors) in characters of the normalised text; of finds that overlap, those with the fewest errors stay."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.seeds.iter(line):
            for k, offset in where:
                _, length, errors = self.fuzzy[k]
                start = max(0, last - size + 1 - offset - errors - 1)
                end = min(len(line), last - size + 1 - offset + length + errors + 1)
                windows.setdefault(k, []).append((start, end))
        found = []
        for k, spans in windows.items():
            pattern, _, _ = self.fuzzy[k]
            for start, end in joined(spans):
                found += [(*m.span(), self.labels[k], sum(m.fuzzy_counts)) for m in matches(pattern, line, start, end)]
        return sorted(x for x in found if not any(y[3] < x[3] and y[0] < x[1] and x[0] < y[1] for y in found))


@cache
def _searcher(settings: Settings, notices: tuple[tuple[str, str], ...]) -> Searcher:
    return Searcher(settings, dict(notices))


def notice_list(notices: DataFrame) -> dict[str, str]:
    """The notices (notice, label) of a table in normal form: words joined by one space. A small reference table: more than MAX_NOTICES rows are an error."""
    rows = notices.select("notice", "label").where("notice is not null and label is not null").orderBy("notice", "label").limit(MAX_NOTICES + 1).collect()
    if len(rows) > MAX_NOTICES:
        raise ValueError(f"more than {MAX_NOTICES} notices")
    normal = {b" ".join(word_list(r["notice"])).decode(): r["label"] for r in rows}
    return {notice: label for notice, label in normal.items() if notice}


def scanner(settings: Settings, notices: tuple[tuple[str, str], ...]):
    """Batches of (doc_id, text) to counts, labels and spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(settings, notices).search
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for value in batch.column(1):
                words = word_list(value.as_py())
                line = b" %b " % b" ".join(words)
                base = {phrase: places(line, phrase) for phrase in BASE}
                starts = [p for x in base.values() for p in x]
                base_labels = {BASE[p] for p, x in base.items() if x}
                text = line.decode("utf-8", "surrogatepass")
                found = search(text)
                spans = [f"{label}:{max(1, text.count(' ', 0, s)) - 1}:{text.count(' ', 0, e)}:{errors}" for s, e, label, errors in found] if found else []
                best = max((1 - errors / max(1, e - s) for s, e, _, errors in found), default=0.0)
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x[2] for x in found})), 1.0 if starts else max(0.0, best), ",".join(spans))
                for column, x in zip(columns, row):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return scan


def licenses(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", notices: DataFrame | None = None) -> DataFrame:
    """Per document: counts and places of the base phrases, labels, score (1 for an exact phrase, else the best notice's similarity), spans.

    spans lists label:first word:word after the last:errors of the fuzzy notices, which are NOTICES or the table notices (notice, label).
    One pass without a shuffle. Null and empty texts have no words and score 0; each row, repeated or not, with whatever id, has its own
    result; very long texts are searched whole; of notices that overlap, those with the fewest errors stay, and ties all stay. Other columns
    aren't looked at. An empty table gives no rows.
    """
    listed = tuple(sorted((NOTICES if notices is None else notice_list(notices)).items()))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scanner(settings, listed), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
