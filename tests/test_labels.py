"""Labels by content: how often a service is called over several runs, and what a run that dies has paid for."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from docweave.jobs.convert import chunk_rows, convert, convert_by_rows
from docweave.operators.label import labelled, rule
from docweave.sources import labels, remote

SCHEMA = "doc_id long, chunk_ix long, chunk string"


@pytest.fixture
def service():
    """A local service that labels every line as a paragraph, and counts. It refuses texts in bad."""
    calls, bad, lock = Counter(), set(), threading.Lock()

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["content-length"])))["messages"][1]["content"]
            with lock:
                calls[text] += 1
            good = text not in bad
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"P: {text.strip()}"}}]} if good else {"error": {"message": "broken"}}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    of = remote.Service(f"http://127.0.0.1:{server.server_port}", "k", tasks=3)
    yield (lambda rows: remote.label(rows, of, ("digest",))), calls, bad
    server.shutdown()


def test_equal_chunks_are_called_once(spark, service, tmp_path):
    label, calls, _ = service
    rows = spark.createDataFrame([(d, k, f"text {(d + k) % 5}") for d in range(6) for k in range(4)] + [(9, 0, None)], SCHEMA)
    store = f"file://{tmp_path}/labels"
    for _ in range(2):
        found = labels.label_once(rows, label, store).collect()
        assert len(found) == 25 and all(r["labelled"] == (r["chunk"] and f"P: {r['chunk']}") and r["error"] is None for r in found)
    assert calls == Counter({f"text {k}": 1 for k in range(5)})
    labels.label_once(rows, label, store, setting="another prompt").count()
    assert calls == Counter({f"text {k}": 2 for k in range(5)})


def test_failed_calls_are_tried_again(spark, service, tmp_path):
    label, calls, bad = service
    rows, store = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b")], SCHEMA), f"file://{tmp_path}/labels"
    bad.add("b")
    found = {(r["doc_id"], r["chunk_ix"]): (r["labelled"], r["error"]) for r in labels.label_once(rows, label, store).collect()}
    assert found == {(1, 0): ("P: a", None), (1, 1): (None, "broken"), (2, 0): (None, "broken")}
    bad.clear()
    found = [(r["labelled"], r["error"]) for r in labels.label_once(rows, label, store).orderBy("doc_id", "chunk_ix").collect()]
    assert found == [("P: a", None), ("P: b", None), ("P: b", None)] and calls == Counter(a=1, b=2)


def test_a_run_that_dies_keeps_its_waves(spark, service, tmp_path):
    label, calls, _ = service
    rows, store, waves = spark.createDataFrame([(1, k, f"text {k}") for k in range(40)], SCHEMA), f"file://{tmp_path}/labels", []

    def dies(part):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("the driver is lost")
        return label(part)

    with pytest.raises(RuntimeError):
        labels.label_once(rows, dies, store, wave=10)
    paid = set(calls)
    assert 0 < len(paid) < 40
    assert labels.label_once(rows, label, store, wave=10).where("labelled is not null").count() == 40
    assert set(calls.values()) == {1} and len(calls) == 40


def test_conversion_with_a_store(spark, service, tmp_path):
    label, calls, _ = service
    text = "A first sentence. " * 30
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short"), (4, None)], "doc_id long, text string")
    want = {r["doc_id"]: r["markdown"] for r in convert(docs, labeler=lambda s: F.lit("P"), max_tokens=50, overlap=0).collect()}
    for _ in range(2):
        found = convert_by_rows(docs, label, f"file://{tmp_path}/labels", max_tokens=50, overlap=0, setting="p1")
        assert {r["doc_id"]: (r["markdown"] or "").split() for r in found.collect()} == {k: (v or "").split() for k, v in want.items()}
    assert set(calls.values()) == {1} and len(calls) == len({r["chunk"] for r in chunk_rows(docs, max_tokens=50, overlap=0).collect()})


def test_columns_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "Title", "x", "y")], SCHEMA + ", labelled string, digest string")
    found = labels.label_once(rows, lambda part: part.select("digest", labelled(F.col("chunk"), rule).alias("labelled"), F.lit(None).cast("string").alias("error")), f"file://{tmp_path}/labels").collect()
    assert [r.asDict() for r in found] == [{"doc_id": 1, "chunk_ix": 0, "chunk": "Title", "digest": "y", "labelled": "H1: Title", "error": None}]
    assert labels.label_once(rows.where("false"), lambda part: part, f"file://{tmp_path}/none").count() == 0


def by_rule(part):
    return part.select("digest", labelled(F.col("chunk"), rule).alias("labelled"), F.lit(None).cast("string").alias("error"))


def test_chunks_are_computed_once_for_an_empty_store(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def chunk(k):
        seen.add(1)
        return f"text {k % 30}"

    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(chunk).asNondeterministic()("id").alias("chunk"))
    for runs in (1, 2):
        labels.label_once(rows, by_rule, f"file://{tmp_path}/labels", wave=10)
        assert seen.value == 40 * runs


def test_a_wave_reads_only_its_own_files(spark, tmp_path):
    rows, read, counts, before = spark.createDataFrame([(1, k, f"text {k}") for k in range(95)], SCHEMA), [], [], []

    def looks(part):
        read.append(part.inputFiles())
        counts.append(part.count())
        before.append(labels.stored_labels(spark, f"file://{tmp_path}/labels").count())
        return by_rule(part)

    assert labels.label_once(rows, looks, f"file://{tmp_path}/labels", wave=10).where("labelled is not null").count() == 95
    assert len({f for files in read for f in files}) == sum(map(len, read)) and sum(counts) == 95 and max(counts) <= 10
    assert before == [sum(counts[:k]) for k in range(len(counts))]  # each wave is in the store before the next begins


def test_waves_beside_each_other(spark, tmp_path):
    rows, store, both, failing = spark.createDataFrame([(1, k, f"text {k}") for k in range(80)], SCHEMA), f"file://{tmp_path}/labels", threading.Barrier(2, timeout=60), []

    def meets(part):
        both.wait()
        if failing:
            raise RuntimeError("the driver is lost")
        return by_rule(part)

    failing.append(True)
    with pytest.raises(RuntimeError):
        labels.label_once(rows, meets, store, wave=10, at_once=2)
    failing.clear()
    assert labels.label_once(rows, meets, store, wave=10, at_once=2).where("labelled is not null").count() == 80
    assert [tuple(r) for r in labels.stored_labels(spark, store).groupBy("digest").count().groupBy("count").count().collect()] == [(1, 80)]


def test_a_store_without_folders_is_read(spark, tmp_path):
    rows, store = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], SCHEMA), f"file://{tmp_path}/labels"
    rows.where("chunk = 'a'").select(labels.digest(F.col("chunk")).alias("digest"), F.lit("P: a").alias("labelled"), F.lit(None).cast("string").alias("error"), F.lit("r").alias("run")).write.parquet(store)
    found = labels.label_once(rows, by_rule, store).orderBy("chunk").collect()
    assert [r["labelled"] for r in found] == ["P: a", "H1: b"] and labels.stored_labels(spark, store).count() == 2


def test_dealt():
    files = [(f"f{k}", n) for k, n in enumerate([10, 10, 4, 6, 1, 10, 3])]
    waves = labels.dealt(files, 10)
    assert sorted(f for w in waves for f in w) == sorted(f for f, _ in files) and all(sum(dict(files)[f] for f in w) <= 10 for w in waves)
    assert labels.dealt([], 10) == []
    assert max(map(len, labels.dealt([(f"f{k:05}", 10) for k in range(3 * labels.MAX_WAVES)], 10))) == 3
