"""Labelled lines ("H1: ...", "P: ..."): deterministic labelers, parsing, and Markdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import SENTENCE_ENDS, filled_lines, strip

# What a label becomes in Markdown.
MARKS = {"H1": "# ", "H2": "## ", "H3": "### ", "H4": "#### ", "P": ""}

Labeler = Callable[[Column], Column]


def rule(line: Column) -> Column:
    """By form: a line that ends like a sentence is a paragraph, a short one a heading."""
    n = F.length(line)
    return F.when(F.right(line, F.lit(1)).isin(list(SENTENCE_ENDS)), "P").when(n <= 20, "H1").when(n <= 40, "H2").when(n <= 60, "H3").when(n <= 80, "H4").otherwise("P")


def mod(line: Column) -> Column:
    """By length modulo 6, so that every label occurs and some lines have none (null)."""
    k = F.length(line) % 6
    return F.when(k < 4, F.concat(F.lit("H"), (k + 1).cast("string"))).when(k == 4, "P")


LABELERS: dict[str, Labeler] = {"rule": rule, "mod": mod}


def labelled(text: Column, labeler: Labeler = rule) -> Column:
    """The text's filled lines with their labels; null for null."""
    one = lambda s: F.concat(F.coalesce(F.concat(labeler(s), F.lit(": ")), F.lit("")), s)
    return F.array_join(F.transform(filled_lines(text), one), "\n")


#: Texts to labelled texts, as many and in the same order.
Model = Callable[[list[str]], list[str]]
#: Models of this Python worker by the labeler that loaded them.
_loaded: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def by_model(load: Callable[[], Model], text: str = "chunk", most: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A labeler of rows that runs a model in the tasks: all columns of the rows, labelled, and error.

    load is called once in each Python worker, whatever tasks it runs, and the model gets up to ``most`` texts at a time, of an Arrow batch as it comes. If it raises,
    the texts are tried one by one, and those that fail have a null label and the reason. Null texts have no label.
    """
    name = uuid.uuid4().hex

    def attempt(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} labels for {len(texts)} texts")
            return [(label, None if label is not None else "no label") for label in found]
        except Exception as e:  # noqa: BLE001 - whatever a model raises is a row's reason
            if len(texts) > 1:
                return [x for t in texts for x in attempt(model, [t])]
            return [(None, f"{type(e).__name__}: {e}"[:500])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, load)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = iter(attempt(model, [t for t in texts if t is not None]) if any(t is not None for t in texts) else [])
                rows = [(None, "no text") if t is None else next(found) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=[*part.schema.names, "labelled", "error"])

    def label(rows: DataFrame) -> DataFrame:
        kept = rows.drop("labelled", "error")
        return kept.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", labelled string, error string")

    return label


def block(line: Column) -> Column:
    """Markdown of a labelled line; null if its label is unknown."""
    out = F.lit(None).cast("string")
    for label, mark in MARKS.items():
        out = F.when(line.startswith(f"{label}: "), F.concat(F.lit(mark), F.substr(line, F.lit(len(label) + 3)))).otherwise(out)
    return out


def blocks(text: Column) -> Column:
    """Markdown blocks of labelled text, in order; lines without a known label are dropped."""
    return F.filter(F.transform(filled_lines(text), block), lambda b: b.isNotNull())


def rejected(text: Column) -> Column:
    """How many filled lines have no known label."""
    return F.size(F.filter(filled_lines(text), lambda s: block(s).isNull())).cast("long")


def markdown(text: Column) -> Column:
    """Blocks separated by blank lines; the empty string if there is none."""
    return strip(F.array_join(blocks(text), "\n\n"))
