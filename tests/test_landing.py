"""The stream: a row for every file, names over batches, counts; and DOCX files that unpack to far more than they are."""

import io
import time
import zipfile

import pytest

from docweave.sources import files
from docweave.streaming import landing
from tests.test_sources import SPACE, docx


def run(spark, folder, out, state, **options):
    query = landing.convert_arriving(spark, str(folder), str(out), str(state), **options)
    query.awaitTermination(180)
    return query


def rows(spark, out):
    return {r["path"].rsplit("/")[-1]: r for r in spark.read.parquet(str(out)).collect()}


def test_every_file_has_a_row(spark, tmp_path):
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    docx(folder / "a.docx", ["Title"])
    (folder / "b.txt").write_text("x")
    (folder / "c.PDF").write_bytes(b"%PDF")
    (folder / "large.docx").write_bytes(b"y" * 5000)
    (folder / "broken.docx").write_bytes(b"z")
    query = run(spark, folder, out, state, max_bytes=4000, rejects=True)
    found = rows(spark, out)
    assert {k: r["error_stage"] for k, r in found.items()} == {"a.docx": None, "b.txt": "type", "c.PDF": "extract", "large.docx": "size", "broken.docx": "extract"}
    assert found["large.docx"]["error"] == "5000 bytes, more than 4000" and found["a.docx"]["markdown"] == "# Title" and found["a.docx"]["out_path"] == "a.md" and found["b.txt"]["out_path"] is None
    assert landing.counts(query) == {"processed": 1, "errors": 4}
    assert run(spark, folder, out, state, max_bytes=4000, rejects=True) and len(rows(spark, out)) == 5


def test_names_over_batches(spark, tmp_path):
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    (folder / "x").mkdir(parents=True)
    pages = {"pdf_pages": lambda content: [content.decode()]}
    docx(folder / "a.docx", ["First"])
    docx(folder / "c.DOCX", ["Same batch"])
    (folder / "c.pdf").write_text("Same batch, later path")
    (folder / "e.docx").write_text("broken: takes no name")
    run(spark, folder, out, state, **pages)
    time.sleep(1.1)
    (folder / "a.pdf").write_text("Second")
    (folder / "b.pdf").write_text("Other")
    (folder / "e.pdf").write_text("Whole")
    run(spark, folder, out, state, **pages)
    found = rows(spark, out)
    assert {k: r["collides"] for k, r in found.items()} == {"a.docx": False, "c.DOCX": False, "c.pdf": True, "e.docx": False, "a.pdf": True, "b.pdf": False, "e.pdf": False}
    assert found["a.pdf"]["markdown"] == "# Second" and found["a.pdf"]["out_path"] == "a.md"


def test_unpacked_size_is_bounded(spark, tmp_path):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("word/document.xml", "w") as part:
            part.write(f'<w:document xmlns:w="{SPACE}"><w:body><w:p>'.encode())
            for _ in range(300):
                part.write(b"<w:r w:x='" + b"x" * 1_000_000 + b"'/>")
            part.write(b"</w:p></w:body></w:document>")
    assert len(bomb.getvalue()) < 3 << 20
    (tmp_path / "bomb.docx").write_bytes(bomb.getvalue())
    found = files.extracted(files.scan(spark, str(tmp_path)), isolate=True).collect()
    assert found[0]["raw_text"] is None and "unpacked" in found[0]["error"]


def test_memory_is_that_of_the_texts():
    import tracemalloc

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("word/document.xml", "w") as part:
            part.write(f'<w:document xmlns:w="{SPACE}"><w:body><w:tbl>'.encode() + b"<w:tr><w:tc/></w:tr>" * 40_000 + b"</w:tbl><w:p>" + b"<w:r><w:rPr/></w:r>" * 40_000 + b"<w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>")
    tracemalloc.start()
    assert files.read_paragraphs(made.getvalue()) == ["end"]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("body, expected", [
    ('<w:p><w:r><w:t>a</w:t><w:tab/><w:t xml:space="preserve"> b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink></w:p><w:p/>', ["a\t b\nc", ""]),
    ("<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>x</w:t></w:r></w:p><w:sectPr/>", ["x"]),
    ("<w:p><w:ins><w:r><w:t>not a run of the paragraph</w:t></w:r></w:ins><w:r><w:noBreakHyphen/><w:cr/><w:t/></w:r></w:p>", ["-\n"]),
    ("", []),
])
def test_paragraphs(body, expected):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{SPACE}"><w:background/><w:body>{body}</w:body></w:document>')
    assert files.read_paragraphs(made.getvalue()) == expected
    with pytest.raises(ValueError, match="unpacked"):
        files.read_paragraphs(made.getvalue(), max_unpacked=20)
