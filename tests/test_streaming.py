from pyspark.sql import functions as F

from groundling.plans.fixtures import VIEWS, view
from groundling.streaming.enrich import counts, with_admin

D = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    view(spark, D, "ping_stream").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(view(spark, D, "ping_stream").schema).parquet(str(tmp_path / "in"))


def test_enrichment_equals_batch(spark, tmp_path):
    out = with_admin(stream(spark, tmp_path), view(spark, D, "admin_grid")).select("event_id", "country", "state")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = with_admin(view(spark, D, "ping_stream"), view(spark, D, "admin_grid")).select("event_id", "country", "state")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect())) and VIEWS


def test_counts(spark, tmp_path):
    q = counts(stream(spark, tmp_path)).writeStream.format("memory").queryName("c").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("c").agg(F.sum("n")).first()[0] == view(spark, D, "ping_stream").count()
