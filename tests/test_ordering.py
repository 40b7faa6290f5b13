import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from columnwright.operators import ordering
from columnwright.operators.ordering import (
    HashOrder, discrete_quantiles, exact_quantiles, fold_quantiles, require_unique_keys, running_totals,
)


def md5(*parts):
    *keys, seed = map(str, parts)
    return hashlib.md5("|".join([*[f"{len(k)}:{k}" for k in keys], seed]).encode()).hexdigest()


@pytest.mark.parametrize("rank_rows", [1_000_000, 3])
def test_cuts_are_the_hashes_at_their_positions(spark, rank_rows):
    df = spark.range(20_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    order = HashOrder(df, ["id"], 7, stratum="y")
    spots = [0, 1, 50, 3_333, 6_665, 6_666, 10_000, 99_999]
    found = order.cuts({0: spots, 1: spots}, rank_rows=rank_rows)
    for y in (0, 1):
        hashes = sorted(md5(i, 7) for i in range(20_000) if (i % 3 == 0) == bool(y))
        assert found[y] == [hashes[s] if s < len(hashes) else "g" for s in spots]
    assert order.counts == {0: 13_333, 1: 6_667}


def test_head_is_the_order_of_the_rows_before_the_cuts(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    order = HashOrder(df, ["id"], 42, stratum="y")
    quotas = {0: 3_000, 1: 1_000}
    cuts = order.cuts({s: [q] for s, q in quotas.items()}, rank_rows=2)
    head = order.head(quotas, cuts)
    by_class = {y: sorted(md5(i, 42) for i in range(5_000) if (i % 4 == 0) == bool(y)) for y in (0, 1)}
    want = sorted(by_class[0][:3_000] + by_class[1][:1_000])
    assert head.total == 4_000
    assert head.cuts({None: [0, 799, 1_600, 3_999]})[None] == [want[i] for i in (0, 799, 1_600, 3_999)]


def test_order_does_not_depend_on_partitions(spark):
    df = spark.range(3_000)
    cuts = [HashOrder(df.repartition(n), ["id"], 1).cuts({None: [10, 1_500]}) for n in (1, 4, 16)]
    assert cuts[0] == cuts[1] == cuts[2]


def test_missing_stratum_is_one_of_its_own(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "a") for i in range(100)], "id int, s string")
    order = HashOrder(df, ["id"], 1, stratum="s")
    assert order.counts == {"a": 80, None: 20}
    cuts = order.cuts({"a": [40], None: [10]})
    marked = df.withColumn("m", order.segment(cuts)).groupBy("s", "m").count().collect()
    assert sorted((r["s"] or "", r["m"], r["count"]) for r in marked) == [
        ("", 0, 10), ("", 1, 10), ("a", 0, 40), ("a", 1, 40)]


@pytest.mark.parametrize("small_rows", [1_000_000, 50])
def test_running_totals(spark, small_rows):
    rng = random.Random(3)
    rows = [(i * 3 - 500, rng.randint(1, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "v int, n int").repartition(5)
    got = {r["v"]: r["t"] for r in running_totals(df, "v", "n", "t", small_rows).collect()}
    total, want = 0, {}
    for v, n in sorted(rows):
        total += n
        want[v] = total
    assert got == want


@pytest.mark.parametrize("leaf_rows", [1_000_000, 20])
def test_exact_quantiles(spark, leaf_rows):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4_000), np.full(2_500, 0.25), rng.integers(0, 9, 500)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    probabilities = [0, 0.1, 0.25, 0.5, 0.501, 0.9, 1]
    got = exact_quantiles(df, "v", probabilities, leaf_rows)
    assert got == pytest.approx(np.quantile(values, probabilities).tolist(), abs=1e-12)


@pytest.mark.parametrize("leaf_rows", [1_000_000, 20])
def test_discrete_quantiles_of_several_columns(spark, leaf_rows):
    rng = np.random.default_rng(6)
    columns = [rng.normal(size=6_000), np.where(rng.random(6_000) < 0.4, 0.25, rng.random(6_000)), rng.integers(0, 5, 6_000)]
    rows = [tuple(None if rng.random() < 0.1 else float(c[i]) for c in columns) for i in range(6_000)]
    df = spark.createDataFrame([(*r, None) for r in rows], "a double, b double, c double, d double")
    want = []
    for i in range(3):
        values = sorted(r[i] for r in rows if r[i] is not None)
        want.append([values[math.ceil(len(values) * s / 8) - 1] for s in range(1, 8)])
    assert discrete_quantiles(df, 8, leaf_rows) == [*want, []]
    assert discrete_quantiles(df.limit(0), 8, leaf_rows) == [[]] * 4


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_repeated_keys_raise(spark):
    require_unique_keys(spark.range(5), ["id"])
    with pytest.raises(ValueError):
        require_unique_keys(spark.range(5).union(spark.range(1)), ["id"])


def test_digits_tell_rows_apart():
    assert ordering.MAX_DIGITS < 32


@pytest.mark.parametrize("leaf_rows", [1_000_000, 40])
@pytest.mark.parametrize("sorted_folds", [False, True])
def test_quantiles_outside_each_fold(spark, leaf_rows, sorted_folds):
    """Also where folds differ wildly, one value fills half of a column, and rows have no fold."""
    import random
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), 7.0 if i % 2 else float(rng.randrange(50)), None if i % 3 else rng.random()) for i in range(900)]
    rows.sort()
    folds = [(i // 300 if sorted_folds else rng.randrange(3)) if i % 10 else None for i in range(900)]
    df = spark.createDataFrame([(*r, f) for r, f in zip(rows, folds)], "a double, b double, c double, fold int")
    found = fold_quantiles(df.withColumn("d", F.lit(None).cast("double")), "fold", 3, 8, leaf_rows)
    for c in range(3):
        for j in range(3):
            own = sorted(r[c] for r, f in zip(rows, folds) if f != j and r[c] is not None)
            assert found[c][j] == [own[-(-len(own) * i // 8) - 1] for i in range(1, 8)]
    assert found[3] == [[], [], []]
