import hashlib
import re

import duckdb

from groundling.llm import queries
from groundling.llm.substring_dedup import remove_seen_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k):
    least = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        if i is not None:
            for a in range(len(w) - k + 1):
                x = tuple(w[a : a + k])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        gone = {a + j for a in range(len(w) - k + 1) if i is not None and least[tuple(w[a : a + k])] < i for j in range(k)}
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want = sorted((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(docs, 13))
    assert sorted(map(tuple, queries.op5_seen_windows(spark, d).collect())) == want
    assert sum(w[2] for w in want)


def test_edges_over_many_parts(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away"
    docs = [(5, base), (3, "x " + base + "\x0by"), (9, None), (10, ""), (None, base), (3, "x " + base + "\x0by"), (-4, "a b c d a b c d a b c d"), (11, "a b c d a b c d"), (12, "\x85 a b\xa0c " * 400), (13, base.upper()), (2**62, base * 200)]
    docs += [(100 + i, base + f" tail{i} " + base) for i in range(60)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, pid string")
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, remove_seen_windows(df, 4, part_bytes=300, block_bits=8, block_entries=4).collect()), key=key) == sorted(brute(docs, 4), key=key)
    assert remove_seen_windows(df.limit(0), 4).count() == 0
