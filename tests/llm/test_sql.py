import duckdb
import pytest

from groundling.llm import queries
from groundling.llm.jaccard_join import near_duplicates
from groundling.llm.line_dedup import remove_all_repeated_lines
from groundling.llm.substring_dedup import remove_seen_windows
from groundling.llm.suffix_dedup import remove_repeated_bytes

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, D)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    rel = db.execute(queries.oracle_sql()[name])
    assert [c[0] for c in rel.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_ids_that_are_no_numbers_count_as_null(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([("a", text), ("7", text), (None, "x")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in remove_seen_windows(df).collect()) == [("7", 0), ("None", 0), ("None", 0)]
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in remove_repeated_bytes(df).collect()) == [("7", True), ("None", False), ("None", True)]
    assert sorted((str(r.doc_id), r.component_id) for r in near_duplicates(df).where("n_shingles > 1").collect()) == [("7", 7), ("None", 7)]
    assert sorted((str(r.doc_id), r.lines.n_removed) for r in remove_all_repeated_lines(df).collect()) == [("7", 0), ("None", 0), ("a", 1)]
