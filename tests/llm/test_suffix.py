import hashlib
import random
from collections import Counter

import duckdb

from groundling.llm import queries
from groundling.llm.suffix_dedup import remove_repeated_bytes


def brute(docs, k):
    raw = [(i, (t or "").encode()) for i, t in docs]
    n = Counter(hash(b[a : a + k]) for _, b in raw for a in range(len(b) - k + 1))
    out = []
    for i, b in raw:
        spans = []
        for a in range(len(b) - k + 1):
            if n[hash(b[a : a + k])] > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + k
                else:
                    spans.append([a, a + k])
        at, kept = 0, b""
        for x, y in spans:
            kept += b[at:x]
            at = y
        out.append((i, len(b), sum(y - x for x, y in spans), len(spans), kept + b[at:], [tuple(s) for s in spans]))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want = sorted((i, n, r, s, hashlib.sha256(t).hexdigest()) for i, n, r, s, t, _ in brute(docs, 200))
    assert sorted(map(tuple, queries.op1_repeated_bytes(spark, d).collect())) == want
    assert sum(w[2] for w in want)


def test_edges_over_many_parts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    base = " ".join(word() for _ in range(60))
    docs = [(1, None), (2, ""), (None, base), (3, base), (3, base), (4, "z" * 500), (5, base[:19]), (6, "\x00" * 30), (7, base * 30)]
    docs += [(10 + i, " ".join(word() for _ in range(20)) + base[rng.randrange(60) : rng.randrange(80, 200)] + word()) for i in range(150)]
    df = spark.createDataFrame([(i, t, b"c") for i, t in docs], "doc_id long, text string, blob binary")
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(brute(docs, 20), key=key)
    for hot in (10_000, 30):  # all by the transform; common anchors string by string
        got = remove_repeated_bytes(df, 20, 8, part_bytes=700, block_entries=32, hot=hot).collect()
        assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4]), [tuple(s) for s in r[5]]) for r in got), key=key) == want
    assert remove_repeated_bytes(df.limit(0)).count() == 0
