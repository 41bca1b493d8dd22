"""Archives: round trip, revisits, selection by index."""

from pyspark.sql import functions as F

from docweave.llm import warc
from docweave.llm.shared import new_path


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "x" * 300_000), (None, "http://e", "lone")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = new_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    assert index.count() == 6
    found = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert {i: r["record_type"] for i, r in found.items()} == {1: "revisit", 2: "response", 3: "revisit", 4: "response", 5: "response", None: "response"}
    assert (found[1]["refers_to"], found[1]["payload"], bytes(found[2]["payload"]).decode()) == (2, None, "<p>é</p>")
    assert found[4]["url"] == "http://cX: y" and len(found[5]["payload"]) == 300_000
    some = warc.read_records(index.where(F.col("page_id").isin(2, 5)), warc.Settings(max_gap=0, max_read=1, block=1000))
    assert sorted(r["page_id"] for r in some.collect()) == [2, 5]


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert warc.planned(pages, warc.Settings(min_revisit=3)).where("refers_to is not null").count() == 0


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(pages, new_path(spark, "warc"))).collect() == []


def test_repeated_and_null_ids_by_value(spark):
    """(page_id, html): ties, repeated rows, one id with two texts, null ids, empty and very long texts; columns with clashing names."""
    rows = [(1, "x"), (1, "x"), (1, "y"), (2, "y"), (None, "y"), (None, "z"), (None, "z"), (3, None), (4, ""), (5, "é" * 400_000)]
    pages = spark.createDataFrame([(i, "u", html, "d", 7) for i, html in rows], "page_id long, url string, html string, digest string, offset int").repartition(2)
    folder = new_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    found = [(r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.read_records(index).collect()]
    want = [(1, "response", None, "x"), (1, "response", None, "x"), (1, "revisit", 2, None), (2, "response", None, "y"), (None, "revisit", 2, None), (None, "response", None, "z"), (None, "response", None, "z"), (3, "revisit", 4, None), (4, "response", None, ""), (5, "response", None, "é" * 400_000)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_record_ids():
    """A revisit names the record of its response; other payloads and other places have other ids."""
    import zlib

    def headers(*row, place=""):
        return warc.parsed(zlib.decompress(warc.record(*row, 6, place), 31))[0]

    response, revisit = headers(2, "u", b"y", "D", None), headers(1, "u", b"y", "D", 2)
    assert revisit["warc-refers-to"] == response["warc-record-id"] != revisit["warc-record-id"]
    ids = [headers(2, "u", b"z", "E", None), headers(None, "u", b"y", "D", None, place="a:0"), headers(None, "u", b"y", "D", None, place="a:9"), response, revisit]
    assert len({h["warc-record-id"] for h in ids}) == 5
