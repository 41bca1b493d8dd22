"""Links and components against brute force on all pairs."""

import random
import re
from itertools import combinations

import numpy as np

from docweave.llm import neardup
from docweave.llm.components import components
from tests.llm.conftest import LONG, ODD, by_id


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_of_copies_variants_and_common_passages(spark, docs_of):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = draw.choices(vocabulary, k=40)
    bases = [draw.choices(vocabulary, k=120) for _ in range(4)]
    rows = []
    for k in range(160):
        words = list(draw.choice(bases)) if k % 4 else passage + draw.choices(vocabulary, k=draw.randint(10, 60))
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((k, (" " if k % 3 else "\n").join(w.upper() if k % 5 == 0 else w for w in words)))
    want = expected(rows)
    found = by_id(neardup.near_duplicates(docs_of(rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert len({c for _, c in want.values()}) > 20


def test_odd_rows(docs_of):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs_of(ODD)).collect()]
    assert len(found) == len(ODD)
    assert found.count((1, 3, 1, True)) == 2 and (7, 3, 1, False) in found and (None, 3, 1, False) in found
    assert {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True), (6, 1, 6, True)} <= set(found)
    assert neardup.near_duplicates(docs_of([])).collect() == []


def test_one_of_each_keeps_columns(docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")])
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("int"))
    kept = neardup.one_of_each(docs)
    assert kept.dtypes == docs.dtypes and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_one_row_of_each_component(docs_of):
    """Repeated ids, null ids with and without a component, texts without words."""
    more = [(2, None), (8, "p q r s t u"), (8, "v w x y z a"), (None, "lone words of no other text"), (None, "lone words of no other text")]
    kept = [(r["doc_id"], r["text"]) for r in neardup.one_of_each(docs_of([*ODD, *more])).collect()]
    eight = [t for i, t in kept if i == 8]
    assert len(eight) == 1 and eight[0] in ("p q r s t u", "v w x y z a")
    want = [(1, ODD[0][1]), (2, None), (3, ""), (4, ODD[4][1]), (None, None), (5, LONG), (6, ODD[8][1]), (None, more[-1][1])]
    assert sorted(kept, key=str) == sorted([*want, (8, eight[0])], key=str)
    assert neardup.one_of_each(docs_of([])).collect() == []


def test_bounds_follow_the_posterior():
    least = neardup.least_matches(neardup.Settings())
    assert list(least) == sorted(least) and least[-1] < 96
    draw = np.random.default_rng(0)
    equal = draw.random((20_000, 128)) < 0.75
    lost = (np.cumsum(equal, axis=1)[:, [31, 63, 95, 127]] < least).any(axis=1)
    assert lost.sum() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["comp"] for r in components(links).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}
