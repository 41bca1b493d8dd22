"""Files that can't be read, services that break off, and chunks that fail are rows with a reason, never exceptions."""

import json
import struct
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docweave.jobs.convert import assembled, chunk_rows, convert, convert_by_rows, convert_files
from docweave.operators.merge import merged
from docweave.operators.segment import hard_split
from docweave.sources.remote import Service, label
from docweave.streaming.landing import convert_arriving
from pyspark.sql import functions as F
from tests.test_sources import docx


@pytest.fixture
def folder(tmp_path):
    docx(tmp_path / "good.docx", ["Title", "A sentence."])
    docx(tmp_path / "damaged.docx", ["x" * 2000])
    data = bytearray((tmp_path / "damaged.docx").read_bytes())
    docx(tmp_path / "encrypted.docx", ["secret"])
    locked = bytearray((tmp_path / "encrypted.docx").read_bytes())
    with zipfile.ZipFile(tmp_path / "packed.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w/>" * 500)
    packed = bytearray((tmp_path / "packed.docx").read_bytes())
    packed[30 + len("word/document.xml") + 3 : 30 + len("word/document.xml") + 12] = b"\xff" * 9  # broken deflate stream
    (tmp_path / "packed.docx").write_bytes(packed)
    data[40:60] = b"\0" * 20
    (tmp_path / "damaged.docx").write_bytes(data)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        start = locked.index(mark) + at
        locked[start : start + 2] = struct.pack("<H", 1)
    (tmp_path / "encrypted.docx").write_bytes(locked)
    (tmp_path / "one.pdf").write_bytes(b"%PDF one")
    (tmp_path / "bad.PDF").write_bytes(b"%PDF bad")
    (tmp_path / "notes.txt").write_text("x")
    docx(tmp_path / "large.docx", ["y" * 5000])
    return tmp_path


def pages(content):
    if content.endswith(b"bad"):
        raise KeyError("no page tree")
    return ["Heading", "", "Text of a page."]


EXPECTED = {"good.docx": None, "damaged.docx": "extract", "encrypted.docx": "extract", "packed.docx": "extract", "one.pdf": None, "bad.PDF": "extract", "notes.txt": "type", "large.docx": "size"}


def test_mixed_folder(spark, folder):
    found = {r["path"].rsplit("/")[-1]: r for r in convert_files(spark, str(folder), pages, max_bytes=4000).collect()}
    assert {k: r["error_stage"] for k, r in found.items()} == EXPECTED
    assert all((r["error"] is None) == (r["error_stage"] is None) == (r["markdown"] is not None) for r in found.values())
    assert "no page tree" in found["bad.PDF"]["error"] and found["good.docx"]["markdown"] == "# Title\n\nA sentence."
    without = {r["path"].rsplit("/")[-1]: r["error"] for r in convert_files(spark, str(folder), max_bytes=4000).collect()}
    assert without["one.pdf"] == "no PDF reader was given" and without["notes.txt"] == "unsupported file type"


@pytest.mark.parametrize("reader", [None, pages])
def test_stream_goes_on(spark, folder, tmp_path_factory, reader):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("out", "state"))
    for _ in range(2):
        convert_arriving(spark, str(folder), out, state, pdf_pages=reader).awaitTermination(120)
    found = {r["path"].rsplit("/")[-1]: r["error_stage"] for r in spark.read.parquet(out).collect()}
    assert found == {**{k: v for k, v in EXPECTED.items() if k != "notes.txt"}, "large.docx": None, "one.pdf": None if reader else "extract"}


class Answers(BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["content-length"])))["messages"][1]["content"]
        self.calls.append(text)
        if text == "silent":
            return self.close_connection or None
        status, body = (503, {"message": "busy", "code": 9}) if text.startswith("fail") else (200, {"choices": []} if text == "empty" else {"choices": [{"message": {"content": "\n".join(f"P: {x}" for x in text.split("\n"))}}]})
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("x-request-id", f"id-{text[:5]}")
        self.send_header("content-length", str(len(data) + (50 if text == "short" else 0)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Answers.calls = []
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Service(f"http://127.0.0.1:{server.server_port}", "k", tasks=1)
    server.shutdown()


def test_answers_that_are_none(spark, service):
    rows = spark.createDataFrame(list(enumerate(["good", "fail", "empty", "short", "silent"])), "doc_id long, chunk string").withColumn("chunk_ix", F.lit(0))
    found = {r["doc_id"]: r for r in label(rows, service).collect()}
    assert found[0]["labelled"] == "P: good" and found[0]["error"] is None and found[0]["request_id"] == "id-good"
    assert (found[1]["error"]["message"], found[1]["request_id"]) == ("busy", "id-fail")
    assert found[2]["error"]["kind"] == "empty" and found[2]["labelled"] is None
    assert "IncompleteRead" in found[3]["error"]["message"] and found[4]["error"]["message"] and found[4]["labelled"] is None
    assert sorted(Answers.calls) == sorted(["good", "fail", "empty", "short", "silent"])  # one call each


def test_conversion_with_a_service(spark, service, tmp_path):
    """Chunks are labelled once; one failing chunk fails its document; the others are merged in order."""
    long = "\n\n".join(f"Part {k} of a text that is split in chunks." for k in range(30))
    docs = spark.createDataFrame([(1, "One short text."), (2, long), (3, "fail this one."), (4, None), (5, long.replace("Part 0", "fail 0")), (6, " ")], "doc_id long, text string")
    result = convert_by_rows(docs, lambda rows: label(rows, service), f"file://{tmp_path}/labels", max_tokens=100, overlap=0)
    found = {r["doc_id"]: r for r in result.collect()}
    calls = len(Answers.calls)
    assert {k: r["error_stage"] for k, r in found.items()} == {1: None, 2: None, 3: "label", 4: "extract", 5: "label", 6: found[6]["error_stage"]} and found[6]["error_stage"] is not None
    assert found[3]["error"] == "busy" and found[2]["markdown"].split("\n\n") == long.split("\n\n")
    assert result.count() == 6 and len(Answers.calls) == calls


def test_rows_and_columns_agree(spark):
    """The conversion by rows gives what the one without a shuffle gives."""
    from docweave.operators.label import labelled, rule

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    none = F.lit(None).cast("string")
    rows = chunk_rows(docs, max_tokens=200, overlap=20)
    by_rows = assembled(docs, rows.select("doc_id", "chunk_ix", labelled(F.col("chunk"), rule).alias("labelled"), none.alias("error")), max_tokens=200, overlap=20)
    columns = ["doc_id", "n_tokens", "route", "markdown", "error_stage"]
    shown = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert shown(by_rows) == shown(convert(docs, max_tokens=200, overlap=20))


def windows(text, width, shared):
    """Plain windows; a blank one is left out and shifts what follows."""
    out, at = [], 0
    while True:
        piece = text[at : at + width]
        if piece.strip():
            out.append(piece)
        if at + width >= len(text):
            return out
        at += width - shared if piece.strip() else width


def test_hard_split_with_and_without_blank_windows(spark):
    texts = ["abcdefghij" * 9 + "é漢𝒳", "a", "a" * 16, "a" * 17, "abc" + " " * 40 + "def" * 9, "line\n" * 30, "x" * 100 + " " * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for tokens, overlap in ((8, 0), (8, 2), (8, 6), (8, 100)):
        width, shared = 16, 2 * overlap if 2 * overlap < 16 else 3
        found = {r["k"]: r["w"] for r in rows.select("k", hard_split(F.col("text"), tokens, overlap).alias("w")).collect()}
        assert [found[k] for k in range(len(texts))] == [windows(t, width, shared) for t in texts]


def test_time_grows_with_the_length(spark):
    """Ten times the text takes about ten times the time, in one line and in many."""

    def seconds(column, text):
        rows = spark.createDataFrame([(text,)], "text string").select(F.length(F.to_json(F.array(column)))).cache()
        began = time.time()
        rows.collect()
        return time.time() - began

    for column, text in ((hard_split(F.col("text"), 100, 10), "word " * 40_000), (merged(F.split("text", "(?<=5)"), 20), ("P: a line of it.\n" * 40 + "P: 5\n") * 100)):
        seconds(column, text)  # compiled
        small, large = seconds(column, text), seconds(column, text * 10)
        assert large < 25 * small + 2
