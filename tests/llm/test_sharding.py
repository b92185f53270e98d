import zlib

import duckdb

from groundling.llm import queries
from groundling.llm.sharding import shard_by_bytes


def check(rows, texts, n=8):
    rows = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    at, total, seen = 0, sum(sizes), {}
    for r in rows:
        assert r["shard"] == at * n // total
        assert r["slot"] == seen.get(r["shard"], 0)
        seen[r["shard"]] = r["slot"] + 1
        at += r["size"]
    got = [0] * n
    for r in rows:
        got[r["shard"]] += r["size"]
    assert all(abs(g - total / n) <= max(sizes) for g in got)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    rows = [r.asDict() for r in queries.op10_byte_shards(spark, d).collect()]
    check(rows, texts.values())
    for r in rows:
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())


def test_edges(spark):
    texts = [None, "", "é", "x" * 100_000, "same", "same", "same"]
    df = spark.createDataFrame([(1 if t == "same" else None, t, 3) for t in texts], "doc_id long, text string, size int")
    check([r.asDict() for r in shard_by_bytes(df).collect()], texts)
    assert shard_by_bytes(df.limit(0)).count() == 0
