"""Quality rules, decontamination, mixing and sharding against brute force and their laws."""

import re
import zlib
from collections import Counter, defaultdict

from docweave.llm import decontamination, mixing, quality, sharding
from docweave.llm.queries import ORACLES, QUERIES
from docweave.llm.shared import roots
from tests.conftest import DATA, rows
from tests.llm.conftest import ODD, by_id


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_base_counts(docs_of):
    texts = ["a b c d e f g h " * 6, "x\n\nx\n y \nx # $", "", None, "one two three four five six seven eight nine " + "one two three four five six seven eight", "é " * 40]
    found = by_id(quality.quality(docs_of(list(enumerate(texts)))))
    for i, text in enumerate(texts):
        w = words(text)
        c, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (found[i]["n_words"], found[i]["word_chars"], found[i]["n_symbols"], found[i]["n_dup_lines"], found[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert found[i]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_rules_keep_columns_and_odd_rows(docs_of):
    docs = docs_of([*ODD, (8, " ".join(f"w{k}" for k in range(50)))])
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and 8 in {r["doc_id"] for r in kept.collect()}
    assert quality.quality(docs_of([])).collect() == []


def as_files(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def reads(df, tmp_path):
    return [x for x in roots(df) if str(tmp_path) in x]


def test_rules_move_no_texts(spark, docs_of, tmp_path):
    """Kept rows come from beside their measures: nothing is joined to the documents, and repeated rows, nulls and every column stay."""
    texts = [" ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(30)), "too short", None]
    docs = as_files(spark, docs_of([(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[0], None, None), (2, texts[2]), (3, texts[3])]), tmp_path)
    kept = quality.kept_documents(docs)
    assert reads(docs, tmp_path) and not reads(kept, tmp_path)
    assert kept.dtypes == docs.dtypes and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("length(text) > 50").collect())) and kept.count() == 4


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []


def test_hits(spark, docs_of):
    ten = "the quick brown fox jumps over the lazy dog again"
    items = spark.createDataFrame([(1, ten + " and on"), (2, "Short item!"), (3, None), (4, ""), (10, ten), (5, "of of of of of of of of of of of")], "item_id long, text string")
    texts = [f"x {ten.upper()} y", "a short-item b short item", "the the the", "quick the brown fox jumps over the lazy dog again", "of " * 25, None, ten.replace("fox", "fox, É")]
    found = by_id(decontamination.contamination(docs_of(list(enumerate(texts))), items))
    owners = {x: {w for w in windows(t)[1]} for x, t in ((1, ten + " and on"), (2, "Short item!"), (10, ten), (5, "of " * 11))}
    for i, text in enumerate(texts):
        w, hit, of = windows(text)[0], set(), set()
        for item, ws in owners.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        of.add(item)
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["n_items"], found[i]["contaminated"]) == (len(w), len(hit), len(of), bool(hit))
    assert found[3]["n_near"] >= 1


def test_clean_documents(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = docs_of(ODD)
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter({2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean_documents(docs, none).count() == len(ODD)
    assert decontamination.contamination(docs_of([]), items).collect() == []


def test_texts_are_cut_into_words_once(spark, docs_of, tmp_path):
    """The number of words comes with the postings; a row of its own for each row of documents, whatever its text or id."""
    docs = as_files(spark, docs_of([*ODD, (8, "A-b  c\u00e9D"), (8, "x")]), tmp_path)
    for items in ([(1, "one two three four five six")], []):
        found = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert not reads(found, tmp_path)
        want = Counter((r["doc_id"], len(windows(r["text"])[0]), 6 * len(items) * ((r["text"] or "").startswith("one two"))) for r in docs.collect())
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in found.collect()) == want


def test_few_hits_move_no_texts(spark, docs_of, tmp_path):
    docs = as_files(spark, docs_of(ODD), tmp_path)
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = decontamination.clean_documents(docs, items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_targets(spark):
    sized = spark.createDataFrame([("b", 100), ("a", 10), (None, 1000), ("c", 500), ("d", 0), ("é", 90)], "source string, size long")
    found = {r["source"]: r for r in mixing.source_targets(sized).collect()}
    order = ["a", "b", "c", "d", "é", None]
    assert [found[s]["weight"] for s in order] == [3, 1, 2, 3, 1, 2]
    size = {"a": 10, "b": 100, "c": 500, "d": 0, "é": 90, None: 1000}
    left, free, goal = 1.5 * 1700, dict(zip(order, [3, 1, 2, 3, 1, 2])), {}
    while free:
        part = left / sum(free.values())
        above = [s for s in free if part * free[s] > 2 * size[s]]
        if not above:
            goal |= {s: part * w for s, w in free.items()}
            break
        for s in above:
            goal[s] = 2 * size[s]
            left -= goal[s]
            free.pop(s)
    assert all(abs(found[s]["target"] - goal[s]) < 1e-6 for s in order)


def test_mix(docs_of):
    docs = docs_of([(k, "a b c", "en", f"s{k % 4}") for k in range(4000)] + [(9000, None), (None, "x", "en", None)])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and times == Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert abs(sum(times.values()) - 1.5 * 4000) < 150
    assert mixing.mix(docs_of([])).collect() == []


def test_packing():
    items = [(7, "a"), (5, "b"), (5, "c"), (4, "d"), (3, "e"), (2, "f"), (2, "g")]
    bins = sharding.best_fit_decreasing(items, 10)
    assert [[n for _, n in b] for b in bins] == [["a", "e"], ["b", "c"], ["d", "f", "g"]]
    where = sharding.pack([(1000, "big"), *[(10, k) for k in range(90)]], 4)
    assert Counter(where.values())[where["big"]] == 1 and sorted(Counter(where.values()).values()) == [1, 30, 30, 30]


def test_shards(docs_of):
    texts = [("copy of one text" if k % 3 == 0 else f"text {k} " + "x" * (k % 97)) for k in range(600)]
    found = sharding.shard_by_bytes(docs_of([*enumerate(texts), *ODD]), 16).collect()
    assert len(found) == 600 + len(ODD)
    slots, of = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None and 10 < r["doc_id"] < 600:
            of[texts[r["doc_id"]]].add(r["shard"])
            assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values()) and set(slots) <= set(range(16))
    assert sharding.shard_by_bytes(docs_of([])).collect() == []


def test_queries_and_sql_agree(spark, duck):
    for name, sql in ORACLES.items():
        found = QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
        assert rows(found) == rows(duck.execute(sql).df()), name


def test_shards_of_near_equal_bytes(spark):
    found = QUERIES["op10_shards"](spark, str(DATA / "sf0.01")).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_every_small_group_is_packed():
    """Counted sizes against best fit of single items by a plain search, 100,000 small groups among them."""
    import random

    draw = random.Random(3)
    for _ in range(200):
        items = [(draw.randint(1, 12), k) for k in range(draw.randint(1, 40))]
        capacity, free, where = draw.randint(12, 30), [], {}
        for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
            fits = [(f, k) for k, f in enumerate(free) if f >= size]
            k = min(fits)[1] if fits else len(free)
            free[k:] = [capacity] if not fits else free[k:]
            free[k] -= size
            where[name] = k
        bins = sharding.best_fit_decreasing(items, capacity)
        assert [sum(size for size, _ in b) for b in bins] == [capacity - f for f in free]
        assert all(Counter(size for size, _ in b) == Counter(size for size, name in items if where[name] == k) for k, b in enumerate(bins))
    sizes = Counter(int(draw.paretovariate(1.2) * 40) for _ in range(100_000))
    placed = sharding.plan(list(sizes.items()), 16)
    assert Counter(size for size, _, number in placed for _ in range(number)) == sizes
    loads = Counter()
    for size, shard, number in placed:
        loads[shard] += size * number
    rest = [n for k, n in loads.items() if n < 1.5 * sum(loads.values()) / 16]
    assert len(loads) == 16 and max(rest) - min(rest) <= max(1, max(rest) // 10_000)


def test_written_shards(spark, docs_of, tmp_path):
    docs = docs_of([*ODD, *((100 + k, f"text {k % 40}") for k in range(100))])
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    plain = lambda df: sorted(map(repr, (tuple(r[c] for c in docs.columns) for r in df.collect())))
    assert plain(back) == plain(docs)
    shards = defaultdict(set)
    for r in back.collect():
        shards[r["text"] or ""].add(r["out_shard"])
    assert all(len(x) == 1 for x in shards.values())


def near_starts(texts, items, slop=3):
    """Proximity matches by plain search over all windows and places."""
    tokens = [windows(t)[0] for t in texts]
    df = Counter(w for t in tokens for w in t)
    out = [0] * len(texts)
    for x in {w for t in items for w in windows(t)[1]}:
        _, off = min((df[w], o) for o, w in enumerate(x))
        for i, t in enumerate(tokens):
            for at, w in enumerate(t):
                start = at - off
                if w == x[off] and start >= -slop:
                    all_near = all(any(0 <= p < len(t) and t[p] == y for p in range(start + o - slop, start + o + slop + 1)) for o, y in enumerate(x))
                    out[i] += all_near and not (start >= 0 and tuple(t[start : start + len(x)]) == x)
    return out


def test_proximity_matches(spark, docs_of):
    import random

    import duckdb

    draw = random.Random(6)
    vocabulary = "a b c dd ee ff gg hh ii jj kk ll".split()
    items = [" ".join(draw.choices(vocabulary, k=k)) for k in (3, 10, 12, 5, 11)] + ["", None]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(40)]
    for item in items[:5]:
        for _ in range(6):
            w = item.split()
            i = draw.randrange(len(w))
            w.insert(draw.randrange(len(w)), w.pop(i))
            texts.append(" ".join([*draw.choices(vocabulary, k=4), *w, *draw.choices(vocabulary, k=4)]))
        texts.append(f"z {item} z")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = by_id(decontamination.contamination(docs_of(list(enumerate(texts))), table))
    want = near_starts(texts, items)
    assert [found[k]["n_near"] for k in range(len(texts))] == want and sum(want) > 20
    con = duckdb.connect()
    for name, values, key in (("documents", texts, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(values)))
    sql = con.execute(decontamination.OP8_SQL).df().set_index("doc_id")
    assert [int(sql.n_near[k]) for k in range(len(texts))] == want
    assert [(int(sql.n_hit[k]), sql.items_sha256[k]) for k in range(len(texts))] == [(found[k]["n_hit"], found[k]["items_sha256"]) for k in range(len(texts))]
