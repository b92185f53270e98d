from pyspark.sql import functions as F

from groundling.plans import catalog

D = "/root/testdata/sf0.001"


def test_road_searches_send_no_names(spark):
    for name in ("nearest_road_walking", "nearest_n_roads"):
        plan = catalog.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "Road " not in plan  # no query of these returns names; the searches would send one with every cell of a road


def test_pairs_of_the_far_north_are_dealt_to_many_tasks(spark):
    found = catalog.queries()["nearby_far_north"](spark, "/root/testdata/sf0.01")
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 12778 and max(tasks) < 0.4 * sum(tasks)  # by size alone adaptive execution puts nearly all into one
