import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, copies int, shard int, pos int, term string, size int, key int, data int, _t int, target int"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", 1, 2, 3, "t", 4, 5, 6, 7, 8) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
#: Nulls, empty and blank texts, repeated rows, ties, a very long text.
ODD = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four five six seven"), (None, None), (5, LONG, None, None), (6, "é" * 50), (7, "one two three four five six seven", "xx", "b")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
