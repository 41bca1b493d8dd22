"""A model in the tasks as a labeler, and merging over rows."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators.label import by_model
from docweave.operators.merge import merged, merged_rows

SCHEMA = "doc_id long, chunk_ix long, chunk string, error string"


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    def load():
        import os
        import uuid

        open(f"{tmp_path}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [f"P: {t}" for t in texts]

    label = by_model(load, most=3)
    rows = spark.createDataFrame([(1, k, f"t{k}", "x") for k in range(50)], SCHEMA).repartition(10)
    for _ in range(3):
        assert {(r["chunk_ix"], r["labelled"], r["error"]) for r in label(rows).collect()} == {(k, f"P: t{k}", None) for k in range(50)}
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) <= 8


def test_one_bad_text_is_one_bad_row(spark):
    sizes = lambda: lambda texts: [f"{len(texts)}" if "bad" not in texts else 1 / 0 for _ in texts]
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 1, "bad", None), (1, 2, None, None), (1, 3, "b", None)], SCHEMA).coalesce(1)
    found = {r["chunk_ix"]: (r["labelled"], r["error"]) for r in by_model(sizes)(rows).collect()}
    assert found == {0: ("1", None), 1: (None, "ZeroDivisionError: division by zero"), 2: (None, "no text"), 3: ("1", None)}
    short = {r["chunk_ix"]: r["error"] for r in by_model(lambda: lambda texts: [])(rows).collect()}
    assert short[0] == "ValueError: 0 labels for 1 texts" and by_model(sizes)(rows.where("false")).count() == 0


@pytest.mark.parametrize("overlap", [0, 20, 300])
def test_rows_merge_as_the_fold_does(spark, overlap):
    draw, lines = random.Random(overlap), ["H1: a", "P: bb", "", "  ", "P: a long line here", "x", "P: bb ", "P: 日本"]
    docs = [(d, ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 30 if d % 3 else 4))) for _ in range(draw.randint(2, 9))]) for d in range(300)]
    docs += [(1000, [f"P: line {k}\nP: line {k + 1}" for k in range(500)])]
    df = spark.createDataFrame(docs, "doc_id long, parts array<string>")
    want = {r["doc_id"]: r["m"] for r in df.select("doc_id", merged(F.col("parts"), overlap).alias("m")).collect()}
    rows = df.select("doc_id", F.posexplode("parts").alias("chunk_ix", "labelled")).repartition(5)
    found = merged_rows(rows, overlap=overlap).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "lines"))).alias("p")).collect()
    got = {r["doc_id"]: "\n".join(line for p in r["p"] for line in p["lines"]).strip() for r in found}
    assert {k: v and v + "\n" for k, v in got.items()} == want
