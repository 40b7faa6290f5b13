import pytest
from pyspark.sql import functions as F

from columnwright.operators import prompts as ops
from columnwright.operators.prediction_cache import PredictionCache
from columnwright.plans import experiment

ROWS = "prompt string, x string, y string, score double, sequence string"


def cached(cache):
    return sorted(map(tuple, cache.rows().collect()), key=str)


def test_cache_keeps_first_scores_and_missing_values(spark, tmp_path):
    cache = PredictionCache.open(spark, str(tmp_path / "it's a cache"), 4)
    first = [("a", "x", "y", 1.0, "s"), ("a", None, "y", 0.0, "t"), ("a", "", None, 1.0, None)]
    cache.add(spark.createDataFrame(first, ROWS))
    cache.add(spark.createDataFrame([("a", "x", "y", 0.0, "other"), ("b", "x", "y", 1.0, "v"), ("b", "x", "y", 0.5, "w")], ROWS))
    want = sorted([*first, ("b", "x", "y", 0.5, "w")], key=str)
    assert cached(cache) == want
    cache.add(spark.createDataFrame([], ROWS))
    # A later session has no such table in its catalog; the folder is enough.
    spark.sql(f"DROP TABLE {cache.table}")
    assert cached(PredictionCache.open(spark, str(tmp_path / "it's a cache"), 4)) == want
    with pytest.raises(ValueError):
        PredictionCache.open(spark, str(tmp_path / "it's a cache"), 8)


def test_questions_equal_those_to_a_plain_cache(spark, tmp_path):
    rows = [(i, f"x{i % 40}" if i % 11 else None, "hot" if i % 3 else f"y{i % 5}") for i in range(300)]
    task = spark.createDataFrame(rows, "id int, x string, y string")
    plain = spark.createDataFrame([("p", f"x{i}", "hot", 0.5, "s") for i in range(20)] + [("p", None, "hot", 0.25, "n")], ROWS)
    cache = PredictionCache.open(spark, str(tmp_path / "cache"), 8)
    cache.add(plain)
    pairs = ops.pairs_cross(task, ["p", "q"])
    known = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert known(cache.missing(pairs)) == known(ops.pairs_to_predict(pairs, plain).select(*ops.PAIR).distinct())
    assert known(cache.collect(pairs)) == known(ops.cache_collect(pairs, plain).select(cache.collect(pairs).columns))


def test_predictions_are_asked_for_once(spark, tmp_path):
    rows = [(i, f"x{i % 9}", "yes" if i % 2 else "no") for i in range(60)]
    task = spark.createDataFrame(rows, "id int, x string, y string")
    cache, asked = PredictionCache.open(spark, str(tmp_path / "cache"), 4), []

    def predict(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("prediction", F.lit("yes")).withColumn("sequence", F.lit("s"))

    collected, same = experiment.evaluate(task, ["id"], ["a"], predict, cache)
    assert same is cache and asked == [18]
    assert ops.prompt_scores(collected).first()["score"] == 0.5
    experiment.evaluate(task, ["id"], ["a", "b"], predict, cache)
    again, _ = experiment.evaluate(task, ["id"], ["a", "c"], predict, cache, strategy="evaluated")
    assert asked == [18, 18, 0] and cache.rows().count() == 36
    assert {r["prompt"]: r["score"] for r in ops.prompt_scores(again).collect()} == {"a": 0.5, "c": None}


@pytest.mark.parametrize("buckets", [5, 16])
def test_cache_is_not_shuffled(spark, tmp_path, buckets):
    """With fewer and with more buckets than shuffle partitions."""
    cache = PredictionCache.open(spark, str(tmp_path / "cache"), buckets)
    cache.add(spark.range(50).select(F.lit("p").alias("prompt"), F.col("id").cast("string").alias("x"), F.lit("y").alias("y"), F.lit(1.0).alias("score"), F.lit("s").alias("sequence")))
    pairs = spark.range(80).select(F.lit("p").alias("prompt"), F.col("id").cast("string").alias("x"), F.lit("y").alias("y"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = cache.missing(pairs)
        plan = missing._jdf.queryExecution().executedPlan().toString()
        assert missing.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The question moves; the cache is read bucket by bucket.
    before, cache_side = plan.split("FileScan")[0], plan[plan.rindex("+- Sort [pair"):]
    assert "Exchange" in before and "Exchange" not in cache_side and "Bucketed: true" in cache_side, plan
