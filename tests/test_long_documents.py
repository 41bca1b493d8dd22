"""Documents are long by their text, whatever the size column says."""

from docweave.jobs.catalogue import QUERIES


def test_missing_and_stale_sizes(spark, tmp_path):
    long, short = "x" * 14_002, "x" * 14_001
    rows = [(1, long, "a", None), (2, long, "a", 5), (3, short, "a", 99_999), (4, long, "a", 14_002), (5, None, "a", 99_999)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["long_documents"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 7001), (2, 7001), (4, 7001)]
