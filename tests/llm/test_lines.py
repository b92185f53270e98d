import hashlib
import random
import re

import duckdb

import corpus_pipeline
from groundling.llm import queries
from groundling.llm.line_dedup import remove_all_repeated_lines, remove_repeated_lines

COUNT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(spark, docs, min_words=20, long_line=50):
    """The same steps one document at a time; line hashes come from Spark, as they decide which fingerprints are selected."""
    lines = {k: t.split("\n") for k, t in docs if t is not None}
    distinct = sorted({x for ls in lines.values() for x in ls})
    h = {r.x: r.h for r in spark.createDataFrame([(x,) for x in distinct] or [("",)], "x string").selectExpr("x", "xxhash64(x) h").collect()}
    both = sorted({(h[a], h[b]) for ls in lines.values() for a, b in zip(ls, ls[1:])})
    g = {(r.a, r.b): r.g for r in spark.createDataFrame(both or [(0, 0)], "a long, b long").selectExpr("a", "b", "xxhash64(a, b) g").collect()}
    first, places = {}, {}
    for k in sorted(lines):
        ls = lines[k]
        gs = [g[h[a], h[b]] for a, b in zip(ls, ls[1:])]
        sel = [("g", x, i) for i, x in enumerate(gs) if len(gs) == 1 or (i + 1 < len(gs) and x < gs[i + 1]) or (i and x <= gs[i - 1])]
        sel += [("l", x, i) for i, x in enumerate(ls) if len(COUNT.findall(x)) >= long_line]
        for kind, x, i in sorted(sel, key=lambda s: s[2]):
            places.setdefault(k, {}).setdefault((kind, x), []).append(i)
        for f, ps in places.get(k, {}).items():
            first.setdefault(f, (k, ps[0]))
    out = {}
    for k, ls in lines.items():
        gone, runs = set(), set()
        for f, ps in places.get(k, {}).items():
            met = [(k, q, p) for q, p in zip(ps, ps[1:])]
            if first[f][0] != k:
                met.append((*first[f], ps[0]))
            for a, q, p in met:
                o, d = lines[a], p - q
                same = lambda i: 0 <= i < len(ls) and 0 <= i - d < len(o) and ls[i] == o[i - d]  # noqa: B023, E731
                s = e = p
                if not same(p):
                    continue
                while same(s - 1):
                    s -= 1
                while same(e + 1):
                    e += 1
                n = sum(len(COUNT.findall(x)) for x in ls[s : e + 1])
                if n >= min_words and (e > s or n >= long_line):
                    runs.add((s, e))
                    gone |= set(range(s, e + 1))
        out[k] = (len(ls), len(gone), len(runs), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r.lines) for r in remove_repeated_lines(df).collect()}
    want = brute(spark, docs)
    assert got == want and sum(v[1] for v in want.values()) > 100
    assert queries.op7_line_runs(spark, d).count() == len(docs)


def test_edges(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))) for _ in range(12)]
    long_line = " ".join(f"v{i}" for i in range(60))
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs += [(100, ""), (101, "\n"), (102, long_line), (103, "a\n" + long_line + "\nb"), (104, "same line of five words\n" * 200), (105, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int")
    got = {r.doc_id: tuple(r.lines) for r in remove_repeated_lines(df, 10).collect()}
    want = brute(spark, docs, 10)
    assert got.pop(105) == (0, 0, 0, None)
    assert got == want
    assert got[103][3] == "a\nb" and got[102][1] == 0
    twice = remove_repeated_lines(df.where("doc_id = 103").union(df.where("doc_id = 103")).union(df.where("doc_id = 102")).union(spark.createDataFrame([(None, long_line, 1)], df.schema))).collect()
    assert sorted((str(r.doc_id), r.lines.n_removed) for r in twice) == [("102", 0), ("103", 1), ("103", 1), ("None", 1)]
    assert remove_repeated_lines(df.limit(0)).count() == 0
    clash = df.where("doc_id = 103").selectExpr("doc_id", "text", "'a' AS _k", "'b' AS _runs", "'c' AS _kept", "'d' AS lines")
    row = remove_all_repeated_lines(clash).first()
    assert (row._k, row._runs, row._kept, row.lines_1, row.lines.n_removed) == ("a", "b", "c", "d", 0)


def whole(docs, min_words=20, long_line=50):
    """Every earlier place of every line, by extension both ways: (lines, removed, stretches, kept) by document."""
    lines = {k: t.split("\n") for k, t in docs}
    words = {k: [len(COUNT.findall(x)) for x in ls] for k, ls in lines.items()}
    at = {}
    for k in sorted(lines):
        for i, x in enumerate(lines[k]):
            at.setdefault(x, []).append((k, i))
    out = {}
    for k, ls in lines.items():
        gone, done = set(), set()
        for i, x in enumerate(ls):
            for a, j in at[x]:
                if (a, j) >= (k, i):
                    break
                if (a, j, i) in done:
                    continue
                o, s, e = lines[a], i, i
                while s and s - 1 + j - i >= 0 and ls[s - 1] == o[s - 1 + j - i]:
                    s -= 1
                while e + 1 < len(ls) and e + 1 + j - i < len(o) and ls[e + 1] == o[e + 1 + j - i]:
                    e += 1
                done |= {(a, p + j - i, p) for p in range(s, e + 1)}
                n = sum(words[k][s : e + 1])
                if n >= min_words and (e > s or n >= long_line):
                    gone |= set(range(s, e + 1))
        out[k] = (len(ls), len(gone), sum(i - 1 not in gone for i in gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def removed(df, *args):
    return {r.doc_id: tuple(r.lines) for r in remove_all_repeated_lines(df, *args).collect()}


def test_passage_of_frequent_lines(spark):
    """Once every neighbouring pair stands in some earlier document, a first place of a pair leads nowhere."""
    rng = random.Random(5)
    pool = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(30)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(30))) for i in range(200)]
    passage = [rng.choice(pool) for _ in range(12)]
    docs += [(500 + i, "\n".join([f"head {i}", *passage, f"tail {i}"])) for i in range(2)]
    want = whole(docs)
    got = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == want and got[501][1] == 12 and got[501][3] == "head 1\ntail 1"


def test_all_runs_against_every_earlier_place(spark):
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 3, 9, 15, 60]))) for _ in range(12)] + [""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(50)]
    docs += [(100, ""), (101, "\n"), (104, "same line of five words\n" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for args in ((), (10,), (30, 12), (1, 1), (0, 5)):
        assert removed(df, *args) == whole(docs, *args), args
    assert removed(spark.createDataFrame([(1, None)], df.schema)) == {1: (0, 0, 0, None)}
    assert remove_all_repeated_lines(df.limit(0)).count() == 0
    line = " ".join(f"v{i}" for i in range(60))
    twice = [(103, "a\n" + line), (103, "a\n" + line), (102, line), (None, line)]
    rows = remove_all_repeated_lines(spark.createDataFrame(twice, df.schema)).collect()
    assert sorted((str(r.doc_id), r.lines.n_removed) for r in rows) == [("102", 0), ("103", 1), ("103", 1), ("None", 1)]


def test_whole_table_and_stage(spark):
    d = "/root/testdata/sf0.01"
    want = whole(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in queries.op7_line_runs(spark, d).collect()}
    assert got == {k: (*v[:3], hashlib.sha256(v[3].encode()).hexdigest()) for k, v in want.items()}
    kept = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert {r.doc_id: r.text for r in kept.collect()} == {k: v[3] for k, v in want.items() if COUNT.search(v[3])}


def test_run_whose_fingerprint_stands_elsewhere_too(spark):
    """Two lines of a repeated run of three stand together in a still earlier document, without the third."""
    line = lambda x: " ".join(f"{x}{i}" for i in range(9))
    run = [line("a"), line("b"), line("c")]
    docs = [(1, "\n".join([*run[:2], line("x")])), (2, "\n".join([line("y"), *run, line("z")])), (3, "\n".join([line("v"), *run, line("w")]))]
    got = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == whole(docs) and [got[i][1] for i in (1, 2, 3)] == [0, 0, 3]


def test_every_run_of_two_lines(spark):
    """Such a run has one pair, which winnowing selects only if it is the smaller one on both sides."""
    word = iter(range(1_000_000))
    line = lambda n: " ".join(f"u{next(word)}" for _ in range(n))
    runs = [(line(12), line(12)) for _ in range(40)]
    docs = [(side * 100 + i, "\n".join([line(9), line(9), *r, line(9), line(9)])) for side in (0, 1) for i, r in enumerate(runs)]
    got = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [got[i][1] for i, _ in docs] == [0] * 40 + [2] * 40 and got == whole(docs)
