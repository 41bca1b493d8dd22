"""Document files in, Markdown files out.

Files are scanned with Spark's binaryFile source, so type and size filters act on the listing and contents are only read where needed.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.paths import file_type, result_name
from docweave.functions.text import blank
from docweave.sources.sink import publish

MAX_BYTES = 32 << 20
#: Bytes of a document's XML.
MAX_UNPACKED = 256 << 20
#: Files of the supported types, in any case.
GLOB = "*.{[dD][oO][cC][xX],[pP][dD][fF]}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content, file_type) of the supported files of a folder, or of one file."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).where(F.col("length") <= max_bytes).select("path", "length", "content", file_type(F.col("path")).alias("file_type"))


def left_out(listed: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, file_type, error_stage, error) of the rows (path, length, file_type) that aren't to be read: unsupported types, and files above max_bytes."""
    stage = F.when(F.col("file_type") == "unsupported", "type").when(F.col("length") > max_bytes, "size")
    reason = F.when(F.col("error_stage") == "type", F.lit("unsupported file type")).otherwise(F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {max_bytes}")))
    return listed.withColumn("error_stage", stage).where("error_stage is not null").select("path", "file_type", "error_stage", reason.alias("error"))


def rejects(spark: SparkSession, path: str, recursive: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """left_out() of a folder, or of one file: what scan() doesn't give. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return left_out(found.select("path", "length", file_type(F.col("path")).alias("file_type")), max_bytes)


class _Bounded:
    """The bytes of a stream, up to a number; one more is an error. What an archive says about its sizes isn't believed."""

    def __init__(self, source, most: int) -> None:
        self._source, self._left, self._most = source, most, most

    def read(self, n: int = -1) -> bytes:
        data = self._source.read(min(n, self._left + 1) if n >= 0 else self._left + 1)
        self._left -= len(data)
        if self._left < 0:
            raise ValueError(f"the document is more than {self._most} bytes when unpacked")
        return data


#: Text of a run's elements other than text.
_SIGNS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
#: Where the runs are whose text counts, seen from the body's children.
_RUNS = ([f"{_W}p", f"{_W}r"], [f"{_W}p", f"{_W}hyperlink", f"{_W}r"])


def read_paragraphs(content: bytes, max_unpacked: int = MAX_UNPACKED) -> list[str]:
    """Texts of the body's own paragraphs, empty ones too. Tables and headers are not visited. Files that are no DOCX raise errors of many kinds.

    The XML is read as it is unpacked and no more than max_unpacked bytes of it; an element is forgotten as soon as it ends. Memory is that of the texts.
    """
    out, texts, ancestors = None, [], []
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as part:
        for event, element in ElementTree.iterparse(_Bounded(part, max_unpacked), events=("start", "end")):
            if event == "start":
                if len(ancestors) == 1 and element.tag == f"{_W}body" and out is None:
                    out = []
                ancestors.append(element)
                continue
            ancestors.pop()
            tags = [x.tag for x in ancestors[:6]]
            if tags[1:2] == [f"{_W}body"] and tags[2:] in _RUNS:
                texts.append((element.text or "") if element.tag == f"{_W}t" else _SIGNS.get(element.tag, ""))
            elif tags[1:] == [f"{_W}body"] and element.tag == f"{_W}p":
                out.append("".join(texts))
                texts = []
            if ancestors and ancestors[-1].tag != f"{_W}t":
                ancestors[-1].clear()
    if out is None:
        raise ValueError("a DOCX without a body")
    return out


PdfReader = Callable[[bytes], "list[str] | None"]


def file_parts(kind: str, content: bytes, pdf_pages: PdfReader | None) -> tuple[list[str] | None, str | None]:
    """(parts, None), or (None, reason) for whatever a reader raises: one bad file is one bad row. Only a library that isn't there is an error."""
    try:
        if kind == "docx":
            return read_paragraphs(content), None
        if pdf_pages is None:
            return None, "no PDF reader was given"
        pages = pdf_pages(content)
        return (None, "unreadable PDF") if pages is None else ([p for p in pages if p], None)
    except ImportError:
        raise
    except Exception as e:  # noqa: BLE001 - damaged files raise errors of every kind
        return None, f"{type(e).__name__}: {e}"[:500]


def extracted(found: DataFrame, pdf_pages: PdfReader | None = None, isolate: bool = False) -> DataFrame:
    """scan() rows with raw_text in place of content; null where a file can't be read.

    Paragraphs and pages are joined by one line feed. A blank DOCX gives the empty string, a blank PDF null. Reading PDF
    needs a function from bytes to page texts; without one, a PDF raises an error instead of passing for an empty file. With isolate,
    it is a row with a null text like every file that can't be read, and the column error gives the reason.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not isolate and pdf_pages is None and (batch["file_type"] != "docx").any():
                raise NotImplementedError("PDF files need a pdf_pages function")
            out = [file_parts(kind, bytes(content), pdf_pages) for kind, content in zip(batch["file_type"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "file_type": batch["file_type"], "parts": [x[0] for x in out], "error": [x[1] for x in out]})

    rows = found.select("path", "file_type", "content").mapInPandas(parts, "path string, file_type string, parts array<string>, error string")
    text = F.array_join("parts", "\n")
    raw = F.when((F.col("file_type") == "docx") | ~blank(text), text)
    error = F.coalesce("error", F.when(raw.isNull(), "no text"))
    return rows.select("path", "file_type", raw.alias("raw_text"), *([error.alias("error")] if isolate else []))


def named_results(results: DataFrame) -> DataFrame:
    """(path, out_path, markdown) of the documents that succeeded; of several inputs with one output name, the first path wins and the others are marked.

    Names decide without the texts. Only the paths that lose, as a rule few, come back to the rows.
    """
    rows = results.where(F.col("markdown").isNotNull()).select("path", result_name(F.col("path")).alias("out_path"), "markdown")
    names = rows.select("path", "out_path").distinct()
    later = names.withColumn("_place", F.row_number().over(Window.partitionBy("out_path").orderBy("path"))).where("_place > 1").select(F.col("path").alias("_path"))
    return rows.join(later, F.col("path") == F.col("_path"), "left").withColumn("collides", F.col("_path").isNotNull()).drop("_path")


def write_markdown(results: DataFrame, folder: str) -> DataFrame:
    """Write one UTF-8 file per document that succeeded, overwriting; returns the names written. See sink.publish(), which also gives the manifest and counts."""
    return publish(results, folder).manifest.where("status = 'written'").select("out_path")
