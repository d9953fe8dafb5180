"""What is small on paper and large in fact stays off the driver."""

from pyspark.sql import functions as F

from gridwarden.llm import simhash
from gridwarden.llm.common import written


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_balls_are_not_broadcast(spark):
    nodes = written(spark.range(2000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("least")), "nodes")
    plan = final_plan(simhash.links(nodes.select("fp")))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_balls_of_groups_are_not_broadcast(spark):
    segments = F.transform(F.sequence(F.lit(1), F.lit(simhash.SEGMENTS)), lambda k: (F.xxhash64("id", k) % (1 << 27)).cast("int"))
    nodes = written(spark.range(500).select(F.xxhash64("id").alias("fp"), segments.alias("segments"), F.lit(0).cast("long").alias("group"), F.array(F.col("id")).alias("beside")), "nodes")
    plan = final_plan(simhash._matches(nodes, F.col("segments"), simhash.SEGMENT_BITS, lambda a, b: simhash._apart(a, b) <= simhash.FIRST_BITS, "group"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
