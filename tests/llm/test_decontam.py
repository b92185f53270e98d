import math
import re

import duckdb
import numpy as np

from groundling.llm import queries
from groundling.llm.decontam import Index, answer_at, find_leaks, leaks, search

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def overlaps(item, passage):
    w = words(item)
    k = min(5, len(w))
    lead = len(words(item[: answer_at(item)]))
    grams = [(i + k <= lead, tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    seen = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
    share = lambda s: len(s & seen) / len(s) if s else -1.0
    return share({g for q, g in grams if q}), share({g for q, g in grams if not q})


def brute(docs, items, threshold=0.4):
    """All items scored against all passages, one by one."""
    bags = [words(t) for _, t in items]
    n, mean = len(items), sum(map(len, bags)) / len(items)
    df = {t: sum(t in b for b in map(set, bags)) for b in bags for t in b}

    def bm25(t, b):
        tf = b.count(t)
        return math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))

    weight = [{t: bm25(t, b) for t in set(b)} for b in bags]
    stride, out = max(32, max(map(len, bags))), set()
    for d, text in docs:
        w = words(text)
        for a in range(0, max(1, len(w) - stride), stride):
            rest = a + 2 * stride >= len(w)
            passage = w[a:] if rest else w[a : a + 2 * stride]
            bag = set(passage)
            for (i, t), own in zip(items, weight, strict=True):
                if sum(v for x, v in own.items() if x in bag) >= threshold * sum(own.values()) and leaks(*overlaps(t, passage)):
                    out.add((d, i))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet' order by item_id").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.op4_benchmark_leaks(spark, d).collect()}
    assert got == brute(docs, items)
    whole = {(a, i) for a, t in docs for i, x in items if " ".join(words(x)) in " ".join(words(t))}
    assert whole and whole <= got


def test_bounds_lose_no_item():
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    text = lambda n: " ".join(vocabulary[(rng.zipf(1.3, n) - 1) % 300])
    items = [(i, text(int(rng.integers(8, 50))) + ". " + text(6)) for i in range(50)]
    docs = [text(400) + " " + (items[i][1] if i % 2 else items[i][1].upper().replace(" ", ", ")) + " " + text(300) for i in range(50)] + ["", text(3), items[7][1]]
    raw = [t.encode() for t in docs]
    got = search(Index(items), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 0.4, most_cells=50)
    assert {(d, i) for d, i, _, q, a in got if leaks(q, a)} == brute(list(enumerate(docs)), items)


def test_any_number_of_indexes_finds_the_same(spark):
    """Scores too: frequencies, lengths and passages are those of all items."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    size = items.selectExpr("sum(octet_length(text)) s").first().s
    flat = lambda n: sorted((r.doc_id, x.item_id, x.question_overlap, x.answer_overlap, round(x.score, 9)) for r in find_leaks(docs, items, threshold=0.2, index_bytes=n).collect() for x in r.leaks)
    one = flat(1 << 30)
    assert one and one == flat(size // 2 + 1) == flat(size // 4 + 1)


def test_question_alone_is_no_leak():
    assert leaks(0.5, 0.5) and leaks(1.0, -1) and leaks(-1, 0.5) and not leaks(1.0, 0.4) and not leaks(0.4, 1.0) and not leaks(-1, -1)


def test_edges(spark):
    item = "What is the colour of the sky on a clear summer day at noon? It is blue."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "one two three"), (4, "?! --")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 50_000 + item.upper().replace(" ", "\n"), 0), (3, "clean text of no interest", 0), (5, "zero one two three four", 0), (6, item[:58], 0)], "doc_id long, text string, score int")
    for size in (1 << 20, 40):
        rows = sorted(find_leaks(docs, bench, index_bytes=size).collect(), key=lambda r: (r.doc_id, -len(r.text or "")))
        assert [sorted((x.item_id or -1) for x in r.leaks) for r in rows] == [[], [], [1, 1], [], [-1], []]
    clash = find_leaks(docs.withColumnRenamed("score", "Leaks"), bench).first()
    assert (clash.leaks_1, clash.leaks) == (0, [])
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert [r.leaks for r in find_leaks(docs, bench.limit(0)).collect()] == [[]] * 6
