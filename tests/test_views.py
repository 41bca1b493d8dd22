"""Stages from SQL."""

from docweave.jobs.views import create_views
from tests.conftest import DATA


def test_views_answer_sql(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    assert create_views(docs, "v_", max_tokens=200, overlap=20) == ["v_sizes", "v_chunks", "v_lines", "v_markdown"]
    found = spark.sql("SELECT count(*) n, count_if(route = 'chunked') long FROM v_sizes").first()
    assert found["n"] == docs.count() and 0 < found["long"] < found["n"]
    assert spark.sql("SELECT min(n) m FROM (SELECT doc_id, count(*) n FROM v_chunks JOIN v_sizes USING (doc_id) WHERE route = 'chunked' GROUP BY doc_id)").first()["m"] >= 2
    assert spark.sql("SELECT count(*) n FROM v_lines WHERE label IS NULL").first()["n"] == 0
    assert spark.sql("SELECT count_if(markdown IS NULL) n FROM v_markdown WHERE error_stage IS NULL").first()["n"] == 0
