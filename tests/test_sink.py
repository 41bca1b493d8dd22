"""The Markdown sink: one evaluation, a commit of the whole, a manifest, and what is left behind when jobs fail."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docweave.jobs.convert import summary
from docweave.sources import sink

SCHEMA = "path string, markdown string, error_stage string, error string"


def visible(folder):
    return sorted(p.name for p in Path(folder).iterdir() if not p.name.startswith(("_", "."))) if Path(folder).exists() else []


@pytest.fixture
def results(spark):
    rows = [(f"/in/d{k}.docx", f"# Text {k} é\n", None, None) for k in range(20)]
    rows += [("/in/d3.pdf", "later", None, None), ("/in/sub/d3.docx", "in a folder", None, None), ("/in/bad.docx", None, "extract", "no text"), ("/in/empty.docx", "", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_publish(spark, results, tmp_path):
    done = sink.publish(results, f"file://{tmp_path}/out")
    found = {r["path"]: r for r in done.manifest.collect()}
    assert len(found) == 24 and visible(tmp_path / "out") == sorted({p.rsplit("/")[-1].rsplit(".", 1)[0] + ".md" for p in found} - {"bad.md"})
    assert (tmp_path / "out/d3.md").read_text() == "# Text 3 é\n" and (tmp_path / "out/empty.md").read_text() == ""
    assert [found[p]["status"] for p in ("/in/d3.docx", "/in/d3.pdf", "/in/sub/d3.docx", "/in/bad.docx")] == ["written", "collides", "collides", "failed"]
    row = found["/in/d3.docx"]
    assert (row["bytes"], row["sha256"]) == (12, hashlib.sha256("# Text 3 é\n".encode()).hexdigest()) and found["/in/bad.docx"]["error"] == "no text"
    assert done.counts == {r: v for r, v in summary(results.withColumn("ok", F.col("markdown").isNotNull())).first().asDict().items()} == {"processed": 23, "errors": 1, "exit_code": 1}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]


def test_manifest_is_ordered(results, tmp_path):
    sink.publish(results, f"file://{tmp_path}/out")
    import pyarrow.parquet as pq

    parts = sorted((tmp_path / "out/_manifest").glob("part-*.parquet"))
    paths = [p for part in parts for p in pq.ParquetFile(part).read(["path"])["path"].to_pylist()]
    assert paths == sorted(paths) and len(paths) == 24


def test_results_are_computed_once(results, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def slow(batches):
        for batch in batches:
            for path in batch["path"]:
                with open(calls / path.replace("/", "_"), "a") as out:
                    out.write("x")
            yield batch

    sink.publish(results.mapInPandas(slow, SCHEMA), f"file://{tmp_path}/out")
    assert [p.read_text() for p in calls.iterdir()] == ["x"] * 24


def test_failed_job_leaves_nothing(spark, results, tmp_path):
    sink.publish(results.where("path = '/in/d1.docx'"), f"file://{tmp_path}/out")
    before = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))

    def fails(batches):
        for batch in batches:
            yield batch
            if (batch["path"] == "/in/d7.docx").any():
                raise ValueError("a task is lost")

    with pytest.raises(Exception, match="a task is lost"):
        sink.publish(results.mapInPandas(fails, SCHEMA), f"file://{tmp_path}/out")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == before


def test_second_run_replaces(spark, results, tmp_path):
    out = f"file://{tmp_path}/out"
    sink.publish(results, out)
    done = sink.publish(spark.createDataFrame([("/in/d1.docx", "new", None, None), ("/in/x.docx", "x", None, None)], SCHEMA), out)
    assert {r["path"] for r in done.manifest.collect()} == {"/in/d1.docx", "/in/x.docx"} and (tmp_path / "out/d1.md").read_text() == "new" and (tmp_path / "out/d2.md").exists()


def test_finish(spark, results, tmp_path, monkeypatch):
    """A driver that dies between staging and publishing, one that dies amid the moves, and one that dies while staging."""
    out = f"file://{tmp_path}/out"

    def dies(*_):
        raise KeyboardInterrupt

    whole = sink._published
    monkeypatch.setattr(sink, "_published", dies)
    with pytest.raises(KeyboardInterrupt):
        sink.publish(results, out)
    assert visible(tmp_path / "out") == []
    staging = next((tmp_path / "out").iterdir())
    rows = spark.read.parquet(f"{staging}/rows").where("path = '/in/d5.docx'").first()
    (staging / "files" / rows["staged"]).rename(tmp_path / "out/d5.md")
    (tmp_path / "out/.staging-dead/files").mkdir(parents=True)
    (tmp_path / "out/.staging-dead/files/x.md").write_text("half a run")
    monkeypatch.setattr(sink, "_published", whole)
    assert sink.finish(spark, out) == 1 and sink.finish(spark, out) == 0
    assert len(visible(tmp_path / "out")) == 21 and (tmp_path / "out/d5.md").read_text() == "# Text 5 é\n"
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]
    assert spark.read.parquet(f"{out}/_manifest").where("status = 'written'").count() == 21


@pytest.mark.parametrize("rows", [[], [("/in/a.docx", None, "type", "x")]])
def test_nothing_to_write(spark, tmp_path, rows):
    done = sink.publish(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/out")
    assert done.manifest.count() == len(rows) and done.counts == {"processed": 0, "errors": len(rows), "exit_code": len(rows)} and visible(tmp_path / "out") == []
