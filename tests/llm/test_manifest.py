"""The Merkle manifest against a tree built by hand, its layout, and the detection of changes."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import manifest as m
from docweave.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA, rows
from tests.llm.conftest import ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def expected(docs):
    """Rows of the contract from (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for d in docs:
        low = None if d[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])
        change = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        by_lang[d[2]].append((d[0], sha("".join(map(field, d))), sha("".join(map(field, (*d[:4], low if change else d[4]))))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels_of([r[1] for r in by_lang[lang]])
    crown = levels_of([trees[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for at, (doc_id, leaf, claimed) in enumerate(by_lang[lang]):
            path, again = [*siblings(trees[lang], at), *siblings(crown, k)], claimed
            for left, right in path:
                again = sha("".join(left) + again + "".join(right))
            root = crown[-1][0]
            yield doc_id, leaf, trees[lang][-1][0], root, sha("".join("".join(a) + "".join(b) for a, b in path)), again, again == root


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _group string, _rank int, key int, item int, path string, root string"


def documents(spark, docs, folder):
    spark.createDataFrame([(*d, "x", 1, 2, 3, "p", "r") for d in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return m.op11_merkle_manifest(spark, str(folder))


def test_layout():
    for levels in range(1, 6):
        found = m.addresses(levels)
        assert sorted(np.concatenate(found)) == list(range(m.tree_size(levels)))
        for depth, at in enumerate(found):
            sample = range(0, len(at), max(1, len(at) // 97))
            assert [m.address(levels, depth, k) for k in sample] == [at[k] for k in sample]
    # four levels: the root and its children first, then each grandchild with its own children as a unit
    assert m.addresses(4)[2][:3].tolist() == [9, 18, 27] and m.addresses(4)[3][:9].tolist() == [10, 11, 12, 13, 14, 15, 16, 17, 19]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 500, 512])
def test_block(n):
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    depth = m.block_levels(n, n, 3)
    nodes = np.zeros((m.tree_size(depth), 32), np.uint8)
    root = m.build(nodes, 0, depth, leaves)
    levels = levels_of([x.hex() for x in leaves])
    assert root.hex() == levels[-1][0] and depth == len(levels)
    found = m.paths(nodes, depth, n)
    assert all(found[k] == [("".join(a), "".join(b)) for a, b in siblings(levels, k)] for k in range(n))


def test_odd_rows(spark, tmp_path):
    docs = [(r[0], r[3] if len(r) > 3 else "A", r[2] if len(r) > 2 else "en", None if k % 3 else k, r[1]) for k, r in enumerate(ODD)]
    docs += [(k, "s", "", k, f"Text {k}") for k in range(70, 90)] + [(10**12, "é", "é", -1, "AÉB"), (3, None, "zz", 0, "UPPER"), (None, None, None, None, None)]
    found = [tuple(r) for r in documents(spark, docs, tmp_path).collect()]
    assert Counter(found) == Counter(expected(docs))
    assert {r[6] for r in found} == {True, False}


def test_several_rounds(spark, monkeypatch):
    """Blocks of 8 leaves, so that a group needs four rounds and the groups three."""
    docs = [(k, "s", f"lang{k % 97:02d}" if k > 600 else "big", k, f"Text {k}") for k in range(1200)]
    df = spark.createDataFrame([(*d, "x", 1, 2, 3, "p", "r") for d in docs], SCHEMA)
    values = [F.col(c) for c in m.DOCUMENT]
    found = m.manifest(df, m.DOCUMENT, "lang", "doc_id", m.tampered(m.leaf(*values), F.col("doc_id"), values), m.Settings(levels=1))
    out = found.select("key", "leaf", "subroot", "root", m.proof_digest(F.col("path")), m.folded(F.col("claimed"), F.col("path")).alias("f"), (F.col("root") == m.folded(F.col("claimed"), F.col("path"))))
    assert Counter(map(tuple, out.collect())) == Counter(expected(docs))


@pytest.mark.parametrize("docs", [[], [(1, "a", "en", 1, "x")]])
def test_small_tables(spark, tmp_path, docs):
    assert [tuple(r) for r in documents(spark, docs, tmp_path).collect()] == list(expected(docs))


def test_changes_are_found(spark):
    docs = [(k, "s", "ab"[k % 2], k, f"text {k}") for k in range(100)]
    df = spark.createDataFrame([(*d, "x", 1, 2, 3, "p", "r") for d in docs], SCHEMA)
    changed = m.leaf(*(F.when(F.col("doc_id") == 42, F.lit("other")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in m.DOCUMENT))
    found = m.manifest(df, m.DOCUMENT, "lang", "doc_id", changed)
    bad = found.where(m.folded(F.col("claimed"), F.col("path")) != F.col("root"))
    assert [r["key"] for r in bad.collect()] == [42]


def test_sql(spark, duck):
    found = QUERIES["op11_merkle_manifest"](spark, str(DATA / "sf0.001")).toPandas()
    assert rows(found) == rows(duck.execute(ORACLES["op11_merkle_manifest"]).df())
