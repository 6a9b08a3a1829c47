"""Joins over bucketed tables: the plain join's rows, no exchange of light keys, heavy keys in parts."""

from pyspark.sql import functions as F

from signalfold.operators import correlate


def bucketed(spark, tmp_path):
    left = spark.range(4000).select(F.when(F.col("id") < 2500, "hot").when(F.col("id") % 40 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("k"), F.col("id").alias("e"))
    right = spark.range(600).select(F.when(F.col("id") < 10, "hot").when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 350).cast("string"))).alias("k"), F.col("id").alias("l"))
    return left, right, correlate.write_bucketed(left, "left_rows", "k", f"{tmp_path}/left", 4), correlate.write_bucketed(right, "right_rows", "k", f"{tmp_path}/right", 4)


def test_bucketed_join_moves_heavy_keys_alone(spark, tmp_path):
    left, right, a, b = bucketed(spark, tmp_path)
    try:
        want = sorted(map(tuple, left.join(right, "k").collect()))
        for least in (100, 10**6):
            assert sorted(map(tuple, correlate.join_bucketed(a, b, "k", least).collect())) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = correlate.join_bucketed(a, b, "k", 100)
        light, heavy = (joined._jdf.queryExecution().executedPlan().children().apply(i).toString() for i in (0, 1))
        assert "SortMergeJoin" in light and "Exchange hashpartitioning" not in light and "SelectedBucketsCount: 4 out of 4" in light
        # 2,500 rows of one key lie in parts of about 100.
        parts = correlate.heavy_keys(a, "k", 100).select(F.ceil(F.col("n") / 100)).first()[0]
        assert parts == 25 and "__part" in heavy
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("drop table left_rows")
        spark.sql("drop table right_rows")
