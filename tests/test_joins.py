import pytest
from pyspark.sql import functions as F

from columnwright.operators.joins import fits_broadcast, hot_key_hashes, lookup_join


def hot_table(spark):
    """A third of the rows share one key, and some keys are missing."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))
    )
    return spark.range(3_000).select("id", key.alias("k"))


def lookup(spark):
    rows = [("hot", 1), (None, 2)] + [(f"k{i}", 10 + i) for i in range(0, 40, 2)]
    return spark.createDataFrame(rows, "k string, v int")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_gives_the_rows_of_a_broadcast_join(spark, how):
    df, right = hot_table(spark), lookup(spark)
    rows = lambda **options: sorted(map(str, lookup_join(df, right, ["k"], how, **options).collect()))
    want = rows(small=True)
    assert rows(small=False, min_hot_rows=200, salts=7) == want
    assert rows(small=False) == want
    values = {r["id"]: r["k"] for r in df.collect()}
    known = {r["k"] for r in right.collect()}
    hits = sum(k in known for k in values.values())
    assert len(want) == {"left": 3_000, "inner": hits, "left_semi": hits, "left_anti": 3_000 - hits}[how]


def test_hot_keys_are_found(spark):
    df = hot_table(spark)
    hot = hot_key_hashes(df, F.xxhash64("k"), min_rows=200)
    assert hot == [spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]]


def test_hot_rows_are_spread(spark):
    df, right = hot_table(spark), lookup(spark)
    joined = lookup_join(df, right, ["k"], small=False, min_hot_rows=200, salts=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 600


def test_broadcast_is_measured(spark):
    df = spark.range(100)
    assert fits_broadcast(df, 100, 10_000)
    assert not fits_broadcast(df, 99, 10_000)
    assert not fits_broadcast(df, 100, 100)


def test_unknown_join_type(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), ["id"], "full")
