import pytest
from pyspark.sql import functions as F

from columnwright.operators import splits
from columnwright.operators.splits import Blocks


def sizes(df, *by):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


@pytest.mark.parametrize("n,k", [(10, 3), (1003, 10), (7, 7)])
def test_kfold_partitions_the_rows_evenly(spark, n, k):
    df = splits.kfold(spark.range(n), ["id"], k)
    counted = sizes(df, "fold")
    assert sorted(counted) == [(i,) for i in range(k)]
    assert [counted[(i,)] for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_too_few_rows_raise(spark):
    with pytest.raises(ValueError):
        splits.kfold(spark.range(3), ["id"], 4)
    with pytest.raises(ValueError):
        splits.kfold(spark.range(0), ["id"], 2)
    with pytest.raises(ValueError):
        splits.subsample_n(spark.range(3), ["id"], 4)


def test_same_folds_for_any_partitioning_and_other_folds_for_another_seed(spark):
    rows = lambda n, seed: [
        r["fold"] for r in splits.kfold(spark.range(500).repartition(n), ["id"], 5, seed).orderBy("id").collect()
    ]
    assert rows(1, 42) == rows(4, 42) == rows(16, 42) != rows(4, 43)


def test_stratified_folds(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("y"))
    counted = sizes(splits.stratified_kfold(df, ["id"], "y", 3), "y", "fold")
    for y in ("a", "b"):
        of_class = [counted[(y, i)] for i in range(3)]
        assert max(of_class) - min(of_class) <= 1
    totals = [counted[("a", i)] + counted[("b", i)] for i in range(3)]
    assert max(totals) - min(totals) <= 1


def test_repeats_have_folds_of_their_own(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("y"))
    out = splits.repeated_stratified_kfold(df, ["id"], "y", 3, 2)
    assert out.count() == 600
    pairs = sizes(out.groupBy("id").pivot("repeat", [0, 1]).agg(F.first("fold")), "0", "1")
    assert len(pairs) == 9


def test_train_quotas_follow_largest_remainders():
    assert splits.train_quotas([700, 300], 0.2) == [560, 240]
    assert splits.train_quotas([5, 5, 1], 0.2) == [4, 3, 1]
    assert sum(splits.train_quotas([58, 341], 0.2)) == 399 - 80


def test_stratified_split(spark):
    df = spark.range(399).select("id", (F.col("id") < 341).cast("int").alias("y"))
    out = splits.split_stratified(df, ["id"], "y")
    assert sizes(out, "y", "is_test") == {(0, False): 46, (0, True): 12, (1, False): 273, (1, True): 68}


def test_training_folds_match_split_then_folds(spark):
    df = spark.range(700).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    train = splits.split_stratified(df, ["id"], "y").where("NOT is_test").drop("is_test")
    want = {r["id"]: r["fold"] for r in splits.kfold(train, ["id"], 5).collect()}
    found, n = splits.training_folds(df, ["id"], "y", 5)
    assert {r["id"]: r["fold"] for r in found.collect()} == want and n == len(want)
    kept, _ = splits.training_folds(df, ["id"], "y", 5, keep_holdout=True)
    rows = {r["id"]: r["fold"] for r in kept.collect()}
    assert len(rows) == 700 and {i: f for i, f in rows.items() if f is not None} == want


def test_train_and_test_are_complements(spark):
    out = splits.split_random(spark.range(1_001), ["id"], 0.8)
    assert sizes(out, "is_train") == {(True,): 801, (False,): 200}


@pytest.mark.parametrize("how", [{"n": 30}, {"frac": 0.3}])
def test_popped_rows_and_rest(spark, how):
    df = spark.range(100)
    popped, rest = splits.pop_rows(df, ["id"], **how)
    assert popped.count() == 30 and rest.count() == 70
    assert popped.join(rest, "id").count() == 0


def test_pop_takes_exactly_one_size(spark):
    for how in ({}, {"n": 1, "frac": 0.1}):
        with pytest.raises(ValueError):
            splits.pop_rows(spark.range(5), ["id"], **how)


def test_blocks(spark):
    df = spark.range(100)
    blocks = Blocks(df, ["id"], 30)
    assert blocks.n_blocks == 3
    rows = [{r["id"] for r in blocks.block(i).collect()} for i in range(3)]
    assert [len(r) for r in rows] == [30, 30, 30] and len(set.union(*rows)) == 90
    for want in (0, 1, 2, 0):
        assert blocks.index == want
        assert {r["id"] for r in blocks.current().collect()} == rows[want]
        blocks.advance()
    blocks.reset()
    assert blocks.index == 0
    assert {r["id"] for r in blocks.random_block().collect()} in rows


def test_strategies(spark):
    df = spark.range(100)
    take = lambda **options: splits.subsample(df, ["id"], n=30, **options).count()
    assert take(strategy="full") == take(strategy="evaluated") == 100
    assert take(strategy="subsample") == take(strategy="random_block") == take(strategy="sequential_block") == 30
    with pytest.raises(ValueError):
        take(strategy="other")


def test_caps(spark):
    df = spark.range(50)
    assert splits.subsample_cap(df, ["id"], None).count() == 50
    assert splits.subsample_cap(df, ["id"], 60).count() == 50
    assert splits.subsample_cap(df, ["id"], 20).count() == 20
    assert splits.sample_row(df, ["id"]).count() == 1


def test_folds_need_no_shuffle(spark):
    plan = splits.kfold(spark.range(1_000), ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


ODD_KEYS = [(None, "a"), ("a", None), ("a|", "b"), ("a", "|b"), (None, None), ("~", "a")]


@pytest.mark.parametrize("n", range(1, 7))
def test_missing_and_joined_keys_are_told_apart(spark, n):
    df = spark.createDataFrame(ODD_KEYS, "x string, y string")
    assert splits.subsample_n(df, ["x", "y"], n).count() == n
    popped, rest = splits.pop_rows(df, ["x", "y"], n)
    assert (popped.count(), rest.count()) == (n, 6 - n)


def test_folds_and_splits_with_missing_keys(spark):
    df = spark.createDataFrame([(*k, i % 2) for i, k in enumerate(ODD_KEYS)], "x string, y string, c int")
    keys = ["x", "y"]
    assert sizes(splits.kfold(df, keys, 3), "fold") == {(i,): 2 for i in range(3)}
    assert sizes(splits.stratified_kfold(df, keys, "c", 3), "fold", "c") == {(i, c): 1 for i in range(3) for c in (0, 1)}
    assert sizes(splits.split_stratified(df, keys, "c", 1 / 3), "is_test") == {(False,): 4, (True,): 2}
    assert sizes(splits.split_random(df, keys, 0.5), "is_train") == {(False,): 3, (True,): 3}
    assert Blocks(df, keys, 2).block(1).count() == 2


def test_a_cut_between_equal_keys_raises(spark):
    df = spark.createDataFrame([("a",)] * 4, "k string")
    for cut in (lambda: splits.subsample_n(df, ["k"], 3), lambda: splits.kfold(df, ["k"], 2),
                lambda: splits.split_random(df, ["k"], 0.5), lambda: splits.sample_row(df, ["k"])):
        with pytest.raises(ValueError):
            cut()
