import os

from pyspark.sql import functions as F

from askgauge.session import cut_lineage, scratch_path, shared_folder, small_side


def test_the_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert scratch_path(spark, "x").startswith(named) and scratch_path(spark, "x") != scratch_path(spark, "x")
    cut_lineage(spark.range(3))
    assert named in spark.sparkContext.getCheckpointDir()
    assert os.listdir(named)


def test_only_counted_sides_are_broadcast(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    plan = lambda side: big.join(side, "k")._jdf.queryExecution().analyzed().toString()
    side = spark.range(10).select(F.col("id").alias("k"))
    assert "broadcast" in plan(small_side(side, 10))
    assert "broadcast" not in plan(small_side(side, 9))
