"""Repeated strings against brute force over all positions."""

import hashlib
import random
import re
from collections import Counter

import pytest

from docweave.llm import repeats as module
from docweave.llm.repeats import Settings, repeats
from tests.llm.conftest import ODD


def expected(texts, n):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + n] for d in data for p in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for p in range(len(d) - n + 1):
            if count[d[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(d)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def found(df):
    return sorted((tuple(r)[1:] for r in df.collect()))


@pytest.mark.parametrize("settings", [Settings(40, 10, 8), Settings(60, 20, 32), Settings(24, 6, 5)])
def test_all_positions(docs_of, settings):
    draw = random.Random(settings.length)
    pool = ["".join(draw.choices("abé ", k=draw.randint(5, 150))) for _ in range(12)]
    texts = ["".join(draw.choice(pool) + "".join(draw.choices("xyz", k=draw.randint(0, 30))) for _ in range(draw.randint(0, 6))) for _ in range(60)]
    texts += ["a" * 130, "ab" * 80, "a" * 40, texts[5], None]
    assert found(repeats(docs_of(list(enumerate(texts))), settings)) == sorted(expected(texts, settings.length))


def test_odd_rows(docs_of):
    assert found(repeats(docs_of(ODD))) == sorted(expected([r[1] for r in ODD], 400))
    assert repeats(docs_of([])).collect() == []
    twice = [(1, "q" * 3 + "".join(map(str, range(300)))), (1, "q" * 3 + "".join(map(str, range(300))))]
    assert found(repeats(docs_of(twice))) == sorted(expected([t for _, t in twice], 400))


def passage_words(texts, n):
    data = [re.split(r"[\x20\x09-\x0D]+", (t or "").strip(" \t\n\v\f\r")) if (t or "").strip(" \t\n\v\f\r") else [] for t in texts]
    count = Counter(tuple(w[p : p + n]) for w in data for p in range(len(w) - n + 1))
    return [len({q for p in range(len(w) - n + 1) if count[tuple(w[p : p + n])] > 1 for q in range(p, p + n)}) for w in data]


def test_passages_of_words(docs_of):
    draw = random.Random(4)
    pool = [" ".join(draw.choices(["a", "bé", "ccc", "d" * 150], k=draw.randint(1, 40))) for _ in range(10)]
    texts = [draw.choice(["", " \t"]) + draw.choice([" ", "\n\n"]).join(draw.choice(pool) + draw.choice(["", " x", " yy z"]) for _ in range(draw.randint(0, 6))) for _ in range(60)]
    texts += ["", None, " ", texts[7], "same " * 30, "\u00a0word\u00a0two " * 12]
    found = {r["doc_id"]: r for r in repeats(docs_of(list(enumerate(texts))), Settings(40, 10, 8), passages=Settings(15, 4, 3, True)).collect()}
    assert [found[k]["n_passage_words"] for k in range(len(texts))] == passage_words(texts, 15)
    assert sorted(tuple(found[k])[1:5] for k in range(len(texts))) == sorted(expected(texts, 40))


def test_sections_of_long_texts(docs_of, monkeypatch):
    """Texts beyond the size that is hashed at once give the same pieces as far as windows go."""
    monkeypatch.setattr(module, "_CHUNK", 50)
    draw = random.Random(9)
    shared = "".join(draw.choices("ab ", k=300))
    texts = ["".join(draw.choices("xyz ", k=200)) + shared + "".join(draw.choices("xyz ", k=333)), "".join(draw.choices("xyz ", k=77)) + shared]
    for settings in (Settings(40, 10, 8), Settings(10, 3, 2, True)):
        import numpy as np

        windows = []
        for t in texts:
            codes = np.frombuffer(t.encode(), np.uint8)
            own = [x for p in module.pieces_of(codes, np.array([0, len(codes)]), settings) for x in zip(*(c.tolist() for c in p[3:]))]
            windows.append(sorted(w for lo, hi, _ in own for w in range(lo, hi + 1)))
            n = len(t.split()) if settings.words else len(t)
            assert windows[-1] == list(range(n - settings.length + 1))
