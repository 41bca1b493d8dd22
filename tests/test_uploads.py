"""Answers to uploads, and URI components."""

import json
from urllib.parse import quote

from pyspark.sql import functions as F

from docweave.functions.text import uri_component
from docweave.jobs.uploads import replies


def test_replies(spark):
    schema = "request long, ix long, filename string, markdown string"
    rows = [(1, 2, "b.txt", None), (1, 1, "a.tar.DOCX", "# A"), (1, 3, "", "x"), (1, 4, "文.pdf", ""), (1, 5, "c.pdf", None), (2, 1, "", None), (2, 2, None, "x"), (None, 1, 'q".docx', "P")]
    found = {r["request"]: r for r in replies(spark.createDataFrame(rows, schema)).collect()}
    first = json.loads(found[1]["body"])
    assert [(e["original_filename"], e["status"], e["message"]) for e in first] == [("a.tar.DOCX", "success", "done"), ("b.txt", "error", "file type not allowed"), ("文.pdf", "error", "no result"), ("c.pdf", "error", "no result")]
    assert [e.get("processed_filename") for e in first] == ["a.tar.md", None, None, None] and "processed_filename" not in first[1]
    assert (found[2]["status"], json.loads(found[2]["body"])) == (400, {"error": "no file was chosen"})
    assert (found[1]["status"], found[None]["status"], json.loads(found[None]["body"])[0]["processed_filename"]) == (200, 200, 'q".md')
    assert replies(spark.createDataFrame([], schema)).collect() == []


def test_uri_component(spark):
    texts = ["a b+c/d?e=f&g#h%21%", "-_.!~*'()", "文字 é\n😀", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", uri_component(F.col("t")).alias("u")).collect()
    assert {r["k"]: r["u"] for r in found} == {k: None if t is None else quote(t, safe="-_.!~*'()") for k, t in enumerate(texts)}
