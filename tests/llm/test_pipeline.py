"""Each stage on its predecessor's rows."""

from collections import Counter

import corpus_pipeline
from docweave.llm.shared import new_path
from tests.llm.conftest import LONG, ODD


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert name == "shards" or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_later_calls_leave_earlier_results_alone(spark):
    """Two runs, and stages called before the results of others are read."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.run(spark, sf_dir)
    stages = [stage(spark, docs, sf_dir) for _, stage in corpus_pipeline.STAGES]
    second = corpus_pipeline.run(spark, sf_dir)
    assert all(x.count() > 0 for x in stages)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(first) == shown(second)


def test_odd_rows_by_value(spark, docs_of, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and empty tables, for each stage."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, LONG), (2, None), (2, ""), (None, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, none = docs_of(ODD), docs_of([])
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    rows, seven = sorted([(r[0], r[1]) for r in ODD], key=repr), ODD[0][1]
    found = {stage.__name__: stage(spark, docs, folder) for _, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for name, df in found.items() if name != "sharded")
    assert shown(found["good"]) == [(5, LONG)]
    assert shown(found["deduplicated"]) == sorted([(1, seven), (2, None), (3, ""), (4, ODD[4][1]), (None, None), (5, LONG), (6, ODD[8][1])], key=repr)
    assert shown(found["decontaminated"]) == [r for r in rows if r[1] not in (seven, LONG)]
    mixed = Counter(shown(found["mixed"]))
    assert set(mixed) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in mixed.items())
    sharded = found["sharded"].collect()
    assert len(sharded) == len(ODD) and len({r["shard"] for r in sharded if r["size"] == len(seven) + 1}) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
