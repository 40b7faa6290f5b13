import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from columnwright.operators import metrics
from columnwright.operators.metrics import auc


def brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("scale", [1e-12, 1.0, 5e6, 1e18])
def test_auc_equals_the_pair_count(spark, scale):
    rng = random.Random(1)
    rows = [(i % 3, int(rng.random() < 0.4), round(rng.random(), 2) * scale) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = {r["g"]: r["auc"] for r in auc(df, "y", "s", ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(brute([(y, s) for h, y, s in rows if h == g]), abs=1e-12)
    whole = auc(df, "y", "s").first()["auc"]
    assert whole == pytest.approx(brute([(y, s) for _, y, s in rows]), abs=1e-12)
    assert auc(df, "y", -F.col("s")).first()["auc"] == pytest.approx(1 - whole, abs=1e-12)


@pytest.mark.parametrize("levels", [(20, 20), (20,), (), (2, 3, 4)])
def test_levels_do_not_matter(spark, levels):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.5), rng.randint(-300, 300)) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s bigint")
    assert auc(df, "y", "s", levels=levels).first()["auc"] == pytest.approx(brute(rows), abs=1e-12)


def test_auc_edge_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, "y int, s double")
    assert auc(frame([(1, 0.5), (1, 0.7)]), "y", "s").first()["auc"] is None
    assert auc(frame([(1, 0.5), (0, 0.5)]), "y", "s").first()["auc"] == 0.5
    assert auc(frame([(1, 0.9), (0, 0.1), (None, 0.5), (1, None)]), "y", "s").first()["auc"] == 1.0
    assert auc(frame([(1, 0.9), (0, 0.1), (0, float("nan"))]), "y", "s").first()["auc"] == 1.0
    assert auc(frame([(1, 0.0), (0, -0.0)]), "y", "s").first()["auc"] == 0.5
    assert auc(frame([(1, None)]).where("y = 2"), "y", "s").first()["auc"] is None


def test_auc_refuses_other_labels(spark):
    with pytest.raises(PySparkException):
        auc(spark.createDataFrame([(1, 0.5), (2, 0.7)], "y int, s double"), "y", "s").collect()


def test_accuracy_counts_missing_predictions_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("b", "b")], "y string, p string")
    assert metrics.score_by(df, metrics.accuracy, "y", "p").first()["score"] == 0.5


def test_mean_score_skips_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, s double")
    assert {r["k"]: r["score"] for r in metrics.mean_score(df, "s", ["k"]).collect()} == {"a": 1.0, "b": None}


def test_classes_and_blocks(spark):
    df = spark.createDataFrame([("B",), ("a",), ("b",)], "y string")
    assert [r["y"] for r in metrics.distinct_classes(df, "y").collect()] == ["a", "b"]
    assert metrics.block_count(spark.range(95), 30).first()["n_blocks"] == 3


@pytest.mark.parametrize("levels", [(20, 20), (), (2, 3, 4)])
def test_best_accuracy_tries_every_threshold(spark, levels):
    rng = random.Random(7)
    rows = [(g, int(rng.random() < 0.3 + s / 60), s) for g in range(3) for s in (rng.randint(-20, 20) for _ in range(200))]
    rows += [(3, 1, 5), (3, 1, 6), (4, 0, 5), (4, None, 1), (5, 1, 1), (5, 0, 1), (5, 0, 2), (5, 0, None)]
    df = spark.createDataFrame(rows, "g int, y int, s bigint")
    got = {r["g"]: r["accuracy"] for r in metrics.best_accuracy(df, "y", "s", ["g"], levels=levels).collect()}
    floats = {r["g"]: r["accuracy"] for r in metrics.best_accuracy(df, "y", F.col("s") / 3, ["g"], levels=levels).collect()}
    for g in range(6):
        own = [(y, s) for h, y, s in rows if h == g and y is not None and s is not None]
        want = max(sum((s > t) == (y == 1) for y, s in own) for t in [-99, *[s for _, s in own]]) / len(own)
        assert got[g] == pytest.approx(want, abs=1e-12) and floats[g] == pytest.approx(want, abs=1e-12)


def test_log_loss(spark):
    import math
    rows = [(1, 900), (0, 900), (0, -2500), (1, 900_000), (0, 900_000), (None, 3), (1, None)]
    df = spark.createDataFrame(rows, "y int, s bigint")
    own = [(y, s / 1000) for y, s in rows if y is not None and s is not None]
    want = -sum(math.log1p(math.exp(-abs(z))) + max(-z if y else z, 0) for y, z in own) / len(own)
    assert metrics.neg_log_loss(df, "y", "s").first()["neg_log_loss"] == pytest.approx(want, abs=1e-12)


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        metrics.metric_named("luck")
