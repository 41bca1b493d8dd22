"""Files in and out, the remote labeler against a local server, and the stream."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docweave.jobs.convert import convert
from docweave.sources.files import extracted, named_results, scan, write_markdown
from docweave.sources.remote import Service, label
from docweave.streaming.landing import convert_arriving

SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{SPACE}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    docx(tmp_path / "a.docx", ["Title", "", "A sentence."])
    docx(tmp_path / "B.DOCX", [])
    (tmp_path / "broken.docx").write_text("no container")
    (tmp_path / "c.txt").write_text("x")
    return tmp_path


def test_files_to_markdown(spark, folder):
    texts = extracted(scan(spark, str(folder)))
    found = {r["path"].rsplit("/")[-1]: r["raw_text"] for r in texts.collect()}
    assert found == {"a.docx": "Title\n\nA sentence.", "B.DOCX": "", "broken.docx": None}
    results = named_results(convert(texts, text="raw_text"))
    assert [r["out_path"] for r in write_markdown(results, f"file://{folder}/out").collect()] == ["a.md"]
    assert (folder / "out/a.md").read_text() == "# Title\n\nA sentence."


def test_names_that_collide(spark):
    rows = spark.createDataFrame([("/i/a.pdf", "y"), ("/i/a.docx", "x")], "path string, markdown string")
    assert {r["path"]: r["collides"] for r in named_results(rows).collect()} == {"/i/a.docx": False, "/i/a.pdf": True}


def test_pdf_needs_a_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    found = scan(spark, str(tmp_path))
    with pytest.raises(Exception, match="pdf_pages"):
        extracted(found).collect()
    assert [r["raw_text"] for r in extracted(found, lambda content: ["one", "", "two"]).collect()] == ["one\ntwo"]
    assert [r["raw_text"] for r in extracted(found, lambda content: ["  "]).collect()] == [None]


def test_remote_labeler(spark):
    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["content-length"])))["messages"][1]["content"]
            bad = text == "bad"
            self.send_response(429 if bad else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"error": {"message": "slow down", "code": 7}} if bad else {"choices": [{"message": {"content": f" P: {text} "}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "doc_id long, chunk_ix long, chunk string")
    found = {r["chunk_ix"]: r for r in label(rows, Service(f"http://127.0.0.1:{server.server_port}/", "k", tasks=2)).collect()}
    server.shutdown()
    assert found[0]["labelled"] == "P: good" and found[0]["error"] is None
    assert found[1]["labelled"] is None and (found[1]["error"]["message"], found[1]["error"]["code"]) == ("slow down", "7")
    with pytest.raises(ValueError):
        Service("", "k")


def test_stream(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("out", "state"))
    for _ in range(2):
        convert_arriving(spark, str(folder), out, state).awaitTermination(120)
    found = {r["path"].rsplit("/")[-1]: r["error_stage"] for r in spark.read.parquet(out).collect()}
    assert found == {"a.docx": None, "B.DOCX": "format", "broken.docx": "extract"}
