import duckdb
import test_decontam
import test_fertility
import test_jaccard
import test_lines
import test_packing

import corpus_pipeline
from groundling.llm.fertility import BANDS

NAMES = [n for n, _ in corpus_pipeline.STAGES]
D = "/root/testdata/sf0.01"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    items = duckdb.sql(f"select item_id, text from '{D}/benchmark.parquet' order by item_id").fetchall()
    rows = [(1_000_000, docs.first().text, "en", "copy", 0), (1_000_001, "tail " + items[0][1] + " " + docs.collect()[5].text, langs[docs.collect()[5].doc_id], "leak", 0)]
    rows += [(None, None, None, None, None), (None, "", "en", "x", 0), (1_000_002, None, "en", "x", 0)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    langs |= {r[0]: r[2] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    was = texts(docs.where("doc_id IS NOT NULL"))

    docs = stages["quality rules"](spark, docs, D)
    now = texts(docs)
    assert set(now) == {k for k, t in was.items() if t is not None and not test_fertility.base(t)[5] and (langs[k] not in BANDS or test_fertility.verdict(t, langs[k]))}
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    was = now

    docs = stages["line dedup"](spark, docs, D)
    now = texts(docs)
    assert now == {k: v[3] for k, v in test_lines.whole(sorted(was.items())).items() if test_lines.COUNT.search(v[3])}
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    was = now

    docs = stages["n-gram Jaccard join"](spark, docs, D)
    now = texts(docs)
    assert set(now) == {i for i, _, c in test_jaccard.brute(sorted(was.items()), 5, 80, 100) if i == c} and len(now) < len(was)
    was = now

    docs = stages["benchmark decontamination"](spark, docs, D)
    now = texts(docs)
    assert set(was) - set(now) == {d for d, _ in test_decontam.brute(sorted(was.items()), items)} and len(now) < len(was)

    got, least = test_packing.check(stages["best-fit packing"](spark, docs, D).collect(), sorted(now.items()), 4096)
    assert got <= least * 1.02 + 1
    assert docs.schema == spark.read.parquet(f"{D}/documents.parquet").schema


def test_run(spark):
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.count() and NAMES[0] == "quality rules"


def test_near_duplicate_stage_keeps_one_row(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t), (5, t), (4, t + " end"), (9, "other words of no use to anyone here"), (None, t), (None, "alone as it is and stays like that"), (7, None), (7, None)]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicate_join(spark, df, "").collect() if r.text)
    assert got == [("4", t + " end"), ("9", rows[3][1]), ("None", rows[5][1])]
