"""Token files: exact round trips of the words, the files and whole tables, and texts encoded in parts against the library alone."""

import io
import random
import zlib
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import token_files as t
from tests.conftest import DATA
from tests.llm.conftest import LONG, ODD


def unpack_by_hand(data, foot):
    """One word after another."""
    words, out = np.frombuffer(data, "<u8").tolist(), []
    for row in foot:
        at = int(row["offset"]) // 8
        own, raw = words[at : at + int(row["words"])], words[at + int(row["words"]) :]
        for word in own:
            n, width = t.SELECTORS[word >> 60]
            body = word & ((1 << 60) - 1)
            out += [raw[body]] if word >> 60 == 0 else [(body >> (k * width)) & ((1 << width) - 1) for k in range(n)]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 119, 120, 121, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("most", [1, 2, 17, 50_257, 1 << 40, 1 << 60])
def test_words(n, most):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, most, n, dtype=np.uint64)
    ids[draw.random(n) < 0.4] = 0
    ids[draw.random(n) < 0.01] = (1 << 64) - 1
    data, foot = t.packed(ids)
    assert np.array_equal(t.unpacked(data, foot), ids) and unpack_by_hand(data, foot) == ids.tolist()
    assert len(foot) == -(-n // t.BLOCK) and int(foot["escapes"].sum()) == int((ids >= 1 << 60).sum())


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3), max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_ids(ids):
    data, foot = t.packed(np.array(ids, np.uint64))
    assert t.unpacked(data, foot).tolist() == ids


def test_as_many_ids_as_fit():
    """The width of the widest id among the next ones decides, and no id of another block shares a word."""
    data, foot = t.packed(np.full(3 * t.BLOCK + 5, 50_000))
    assert foot["words"].tolist() == [342, 342, 342, 2] and len(data) == 8 * sum(foot["words"].tolist())


def test_any_range_of_a_file(monkeypatch):
    monkeypatch.setattr(t, "TOGETHER", 2)
    draw, out = np.random.default_rng(1), io.BytesIO()
    docs = [draw.integers(0, 50_257, n) for n in (0, 1, 5000, 3, 2048, 0, 7)]
    docs[2][77] = (1 << 62) + 1
    file = t.Writer(out)
    for k, ids in enumerate(docs):
        file.add(None if k == 3 else k, ids)
    file.close()
    read, whole = t.Reader(out, len(out.getvalue())), np.concatenate(docs)
    assert read.docs["tokens"].tolist() == [len(d) for d in docs] and read.docs["null"].tolist() == [0, 0, 0, 1, 0, 0, 0]
    for start, stop in ((0, len(whole)), (0, 0), (1023, 1025), (1024, 2048), (5000, 5001), (78, 78), (len(whole) - 1, len(whole))):
        assert np.array_equal(read.ids(start, stop), whole[start:stop])
    with pytest.raises(ValueError, match="not a whole one"):
        t.Reader(io.BytesIO(out.getvalue()[:-3]), len(out.getvalue()) - 3)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(t.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(t, "_SLICE", 40)
    encoder, draw = t.Encoder(t.default_tokenizer(), 2, most=300), random.Random(3)
    signs = [" ", " ", "\n", "\t", "a", "B", "é", "'", "s", ".", ",", "1", "<|endoftext|>", "　", "\x1c", "\x85", "日", "ǅ", "!", "×", "​", "😀"]
    texts = ["", " ", "a  b", "don't we'll x's", "x. y,, z!? 3.5", "  ", "a " * 100, "word " * 30 + "  " + "other, " * 30]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 120))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text).tolist() == ids_of(tokenizer, text)
    assert encoder.encode(None).tolist() == [2]


def rows_of(tokenizer, docs):
    """(doc_id, start, n_tokens, crc) of (doc_id, text), in order."""
    found = [(d, ids_of(tokenizer, text)) for d, text in docs]
    starts = [0, *accumulate(len(ids) for _, ids in found)]
    return [(d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (d, ids), start in zip(found, starts)]


def test_query(spark, tokenizer):
    folder = DATA / "sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    found = [tuple(r) for r in t.op13_token_files(spark, str(folder)).orderBy("start").collect()]
    assert found == rows_of(tokenizer, docs)


def test_odd_rows(spark, docs_of, tokenizer, tmp_path):
    docs = [*ODD, (-5, LONG * 3), (9, "日本語 " * 500)]
    docs_of(docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = t.op13_token_files(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x or 0))
    content = lambda rows: sorted((-99 if r[0] is None else r[0], *r[2:]) for r in rows)
    assert content(found) == content(rows_of(tokenizer, [d[:2] for d in docs]))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(found, found[1:])) and found[0]["start"] == 0


def test_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert t.op13_token_files(spark, str(tmp_path)).collect() == []


def test_ids_are_in_files(spark, docs_of, tokenizer, tmp_path):
    docs = [(k, f"text {k} " * (k % 7)) for k in range(500)]
    index = t.write_ids(docs_of(docs).repartition(5), f"file://{tmp_path}/ids", t.Settings(t.default_tokenizer(), 50_256))
    files = index.orderBy("base").collect()
    whole, last = [], -1
    for row in files:
        path = row["file"].removeprefix("file://")
        with open(path, "rb") as source:
            read = t.Reader(source, source.seek(0, 2))
            assert row["base"] == len(whole) and read.docs["doc_id"].tolist() == sorted(read.docs["doc_id"].tolist()) and read.docs["doc_id"][0] > last
            whole, last = whole + read.ids(0, row["n_ids"]).tolist(), read.docs["doc_id"][-1]
    assert whole == [i for _, text in docs for i in [*ids_of(tokenizer, text)[:-1], 50_256]]
    one = t.read_ids(index.where(f"part = {files[-1]['part']}")).collect()
    assert len(one) == files[-1]["n_docs"]
