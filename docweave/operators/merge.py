"""Put labelled chunks together again without the lines that they share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import blank, bound, folded, splitlines, strip
from docweave.operators.segment import OVERLAP_TOKENS

TOKENS_A_LINE = 20


def search_depth(overlap: int = OVERLAP_TOKENS) -> int:
    """Lines to compare at most; merging looks for shared lines even without an overlap."""
    return min(int(overlap / TOKENS_A_LINE * 1.2) + 3, 20) if overlap > 0 else 15


def shared_lines(before: Column, after: Column, depth: int) -> Column:
    """The largest k of which the last k lines before equal the first k after, once stripped; one with k > 1 needs a line of over three characters."""
    n = F.least(F.size(before), F.size(after), F.lit(depth))

    def best(ends: Column) -> Column:
        def match(starts: Column) -> Column:
            def fits(k: Column) -> Column:
                return (F.slice(ends, F.size(ends) - k + 1, k) == F.slice(starts, F.lit(1), k)) & ((k == 1) | F.exists(F.slice(starts, F.lit(1), k), lambda s: F.length(s) > 3))

            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.size(starts)), fits)), F.lit(0))

        return bound(F.transform(F.slice(after, F.lit(1), n), strip), match)

    return F.when(n > 0, bound(F.transform(F.slice(before, F.size(before) - n + 1, n), strip), best)).otherwise(F.lit(0))


def merged(parts: Column, overlap: int = OVERLAP_TOKENS) -> Column:
    """One labelled text from an array of labelled chunks in order.

    The fold gives out the lines of each chunk as an array of its own and carries the last few lines of all. Lines are joined once, at the end.
    """
    depth = search_depth(overlap)
    state = lambda out, tail: F.struct(out.alias("out"), tail.alias("tail"))
    last = lambda lines_: F.slice(lines_, F.greatest(F.size(lines_) - depth + 1, F.lit(1)), F.lit(depth))

    def add(acc: Column, part: Column) -> Column:
        more = lambda lines_: state(F.concat(acc["out"], F.array(lines_)), last(F.concat(acc["tail"], last(lines_))))

        def with_lines(now: Column) -> Column:
            def after(k: Column) -> Column:
                gap = ~blank(F.element_at(acc["tail"], -1)) & ~blank(F.get(now, F.lit(0)))
                apart = F.when(gap, F.concat(F.array(F.lit("")), now)).otherwise(now)
                return bound(F.when(k > 0, F.slice(now, k + 1, F.size(now) - k)).otherwise(apart), more, acc)

            return F.when(F.size(now) == 0, acc).when(F.size(acc["tail"]) == 0, more(now)).otherwise(bound(shared_lines(acc["tail"], now, depth), after, acc))

        return F.when(blank(part), acc).otherwise(bound(splitlines(part), with_lines, acc))

    def all_lines(first: Column) -> Column:
        begin = state(F.array(first), last(first))
        return strip(F.array_join(F.flatten(folded(F.slice(parts, F.lit(2), F.size(parts) - 1), begin, F.array().cast("array<array<string>>"), add)), "\n"))

    joined = bound(splitlines(F.get(parts, F.lit(0))), all_lines)
    many = bound(joined, lambda t: F.when(F.length(t) > 0, F.concat(t, F.lit("\n"))).otherwise(t))
    return F.when(F.size(parts) == 0, F.lit("")).when(F.size(parts) == 1, strip(F.get(parts, F.lit(0)))).otherwise(many)


def _shared(before: list[str], after: list[str]) -> int:
    """shared_lines() of stripped lines."""
    for k in range(min(len(before), len(after)), 0, -1):
        if before[-k:] == after[:k] and (k == 1 or any(len(s) > 3 for s in after[:k])):
            return k
    return 0


def merged_rows(labels: DataFrame, key: str = "doc_id", overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, chunk_ix, lines): what each labelled chunk (key, chunk_ix, labelled) adds to its document; merged() for documents of any length.

    A task goes through its chunks in order and carries the last few lines of the document, never the document. The lines of a document's rows, one
    after another, are those that merged() joins. Null and blank chunks add nothing, but for the first, whose lines are all there.
    """
    depth, key_type = search_depth(overlap), dict(labels.dtypes)[key]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, tail = object(), []
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                now = (text or "").splitlines()
                if doc != last_key:
                    last_key, tail, more = doc, [], now
                elif not (text or "").strip():
                    more = []
                elif not tail:
                    more = now
                elif k := _shared([s.strip() for s in tail[-depth:]], [s.strip() for s in now[:depth]]):
                    more = now[k:]
                else:
                    more = [""] * bool(tail[-1].strip() and now[0].strip()) + now
                tail = (tail + more[-depth:])[-depth:]
                out.append(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=[key, "chunk_ix", "lines"])

    rows = labels.select(F.col(key).alias(key), F.col("chunk_ix").cast("long").alias("chunk_ix"), "labelled").repartition(key).sortWithinPartitions(key, "chunk_ix")
    return rows.mapInArrow(add, f"`{key}` {key_type}, chunk_ix long, lines array<string>")
