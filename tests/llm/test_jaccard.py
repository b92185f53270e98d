import random
import re

import duckdb
import numpy as np
import pytest

from groundling.llm import jaccard_join, queries
from groundling.llm._spark import connected
from groundling.llm._trie import Classes, links
from groundling.llm.jaccard_join import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    classes, by = Classes(), {}
    for x, (_, s) in enumerate(sets):
        for t in s:
            by.setdefault(t, []).append(x)
    pairs = {(a, b) for m in by.values() for a in m for b in m if a < b}
    for a, b in pairs:
        n = len(sets[a][1] & sets[b][1])
        if den * n >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            classes.join(a, b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            r = classes.find(x)
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(classes.find(x))) for x, (i, s) in enumerate(sets)]


key = lambda r: (str(r[0]), *map(str, r[1:]))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want = brute(docs, 3, 90, 100)
    assert sorted(map(tuple, queries.op9_shingle_join(spark, d).collect())) == sorted(want)
    assert sum(i != c for i, _, c in want) > 20


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    """A filter and a map in Python in one task hold a worker each, and executors keep both beside the JVM."""
    plans = []
    write = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    queries.op9_shingle_join(spark, "/root/testdata/sf0.001").count()
    assert max(p.count("ArrowEvalPython") for p in plans) == 1


@pytest.mark.parametrize("seed", range(20))
def test_tree_joins_what_pairs_join(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), 40) for _ in range(3)]
    sets = []
    for m in range(60):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s.discard(rng.choice(list(s)))
            s.add(rng.randrange(200))
        sets.append((m, np.array(sorted(s), np.uint64)))
    got, want = Classes(), Classes()
    links(sets, 8, 10, got)
    for a, x in sets:
        for b, y in sets:
            n = len(set(x.tolist()) & set(y.tolist()))
            if 10 * n >= 8 * (len(x) + len(y) - n):
                want.join(a, b)
    assert [got.find(m) for m, _ in sets] == [want.find(m) for m, _ in sets]


def test_edges_and_blocks(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [word() for _ in range(80)]
    docs = [(1, None), (2, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (None, "one two"), (None, "only here once more again"), (6, "x " * 50), (7, "X\tx " * 40)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = word()
        docs.append((100 + i, " ".join(w)))
    docs += [(300 + i, " ".join(base[:25] + [word() for _ in range(60)])) for i in range(60)]
    docs += [(300, " ".join(base)), (300, " ".join(base))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    for block_bytes in (1 << 24, 3000):
        got = near_duplicates(df, 3, 80, 100, block_bytes=block_bytes).drop("text_hash").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, 3, 80, 100), key=key)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (50, 51), (1, 1), (160, 20)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 20 for i in range(100, 161)) and got[7] == got[9] == 3 and got[51] == 50


@pytest.mark.parametrize("seed", range(10))
def test_bitmaps_allow_every_similar_pair(seed):
    from groundling.llm.jaccard_join import crossing, parities, weak_classes

    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**60, n, dtype=np.uint64) for n in (60, 300, 310, 900)]
    sets = []
    for m in range(80):
        s = base[rng.integers(4)].copy()
        hit = rng.random(len(s)) < rng.random() * 0.2
        s[hit] = rng.integers(0, 2**60, int(hit.sum()), dtype=np.uint64)
        sets.append(np.unique(s[: len(s) - rng.integers(20)]))
    size = np.array([len(s) for s in sets])
    bitmaps = parities(np.repeat(np.arange(80), size), np.concatenate(sets), size, size > 0)
    got = {x: i for i, c in enumerate(weak_classes(list(zip(range(80), size.tolist(), bitmaps, strict=True)), 8, 10)) for x in c}
    for a in range(80):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 10 * n >= 8 * (size[a] + size[b] - n):
                assert a in got and got[a] == got[b]
                apart = [(i, int(size[i]), int(i == a), bitmaps[i]) for i in range(80)]
                assert {a, b} <= set(crossing(apart, 8, 10))
    assert len(set(got.values())) >= 3
