"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import (
    LINE_CATEGORIES, LINE_FEATURES, LINE_KEYS, LINE_NUMBERS, LINES_SQL, QUALITY_CATEGORIES,
    QUALITY_FEATURES, QUALITY_KEYS, QUALITY_NUMBERS, QUALITY_SQL, importance_sql, lines, noise_sql,
    quality, sequential_sql, stored_quality, stratified_fold_sql,
)
from columnwright.catalog.registry import query
from columnwright.operators import bayes, selection, splits

KEYS, LABEL = QUALITY_KEYS, "quality"
SPLIT_SQL = stratified_fold_sql(QUALITY_SQL, KEYS, LABEL, 3)


RING = "__ring"


def _importance(df, features, keys=KEYS, label=LABEL):
    # The hash of the ring takes the place of the keys, which nothing else needs.
    columns = [label, *features, selection.ring_hash(keys).alias(RING)]
    folded = splits.stored_stratified_kfold(df, keys, label, 3, columns=columns)
    weighted = bayes.weigh(folded, [RING], label, "fold", 3, features)
    return selection.permutation_importance(weighted, hashed=RING)


USELESS = ["l_quantity", "amount", "one", "none", "l_tax", "l_linestatus", "l_discount"]


@query("useless_features", """
    SELECT feature, useless FROM (
      SELECT 'l_quantity' AS feature, min(l_quantity) = max(l_quantity) AS useless FROM lineitem
      UNION ALL SELECT 'amount', count(*) FILTER (WHERE l_quantity IS DISTINCT FROM CAST(l_quantity AS DOUBLE)) = 0 FROM lineitem
      UNION ALL SELECT 'one', true UNION ALL SELECT 'none', true
      UNION ALL SELECT 'l_tax', min(l_tax) = max(l_tax) OR count(*) FILTER (WHERE l_tax <> l_quantity) = 0 FROM lineitem
      UNION ALL SELECT 'l_linestatus', min(l_linestatus) = max(l_linestatus) FROM lineitem
      UNION ALL SELECT 'l_discount', min(l_discount) = max(l_discount) OR count(*) FILTER (WHERE l_discount <> l_tax) = 0 FROM lineitem)""")
def useless_features(spark, sf):
    df = lines(spark, sf).select(
        *LINE_KEYS, "l_quantity", F.col("l_quantity").alias("amount"), F.lit(1).alias("one"),
        F.lit(None).cast("string").alias("none"), "l_tax", "l_linestatus", "l_discount",
    )
    useless = selection.useless_features(df, LINE_KEYS, USELESS)[None]
    return spark.createDataFrame([(f, f in useless) for f in USELESS], "feature string, useless boolean")


IMPORTANCE_SQL = importance_sql(SPLIT_SQL, KEYS, LABEL, QUALITY_NUMBERS, QUALITY_CATEGORIES, 3)


@query("permutation_importance",
       f"SELECT fold, feature, round(importance, 6) AS importance FROM ({IMPORTANCE_SQL})")
def permutation_importance(spark, sf):
    found = _importance(quality(spark, sf), QUALITY_FEATURES)
    return found.withColumn("importance", F.round("importance", 6))


@query("permutation_importance_lines", "SELECT fold, feature, round(importance, 6) AS importance FROM (" + importance_sql(
    stratified_fold_sql(LINES_SQL, LINE_KEYS, "returned", 3), LINE_KEYS, "returned", LINE_NUMBERS, LINE_CATEGORIES, 3) + ")")
def permutation_importance_lines(spark, sf):
    found = _importance(lines(spark, sf), LINE_FEATURES, LINE_KEYS, "returned")
    return found.withColumn("importance", F.round("importance", 6))


@query("prune_round", f"""
    SELECT fold, feature FROM (
      SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance, feature) AS r, count(*) OVER (PARTITION BY fold) AS n
      FROM ({IMPORTANCE_SQL})) WHERE r > ceil(0.3 * n)""")
def prune_round(spark, sf):
    found = _importance(quality(spark, sf), QUALITY_FEATURES)
    return selection.prune_round(found, 0.3).select("fold", "feature")


NOISE = ["__noise_0", "__noise_1", "__noise_2"]
NOISY_SQL = "SELECT *, " + ", ".join(
    f"{noise_sql(KEYS, i)} AS {c}" for i, c in enumerate(NOISE)) + f" FROM ({SPLIT_SQL})"
NOISY_IMPORTANCE_SQL = importance_sql(NOISY_SQL, KEYS, LABEL, [*QUALITY_NUMBERS, *NOISE], QUALITY_CATEGORIES, 3)


@query("noise_threshold", f"""
    WITH i AS (SELECT * FROM ({NOISY_IMPORTANCE_SQL})),
    bar AS (SELECT fold, max(importance) AS bar FROM i WHERE feature LIKE '\\_\\_noise%' ESCAPE '\\' GROUP BY 1)
    SELECT fold, feature, round(importance, 6) AS importance, importance > bar AS keep
    FROM i JOIN bar USING (fold) WHERE feature NOT LIKE '\\_\\_noise%' ESCAPE '\\'""")
def noise_threshold(spark, sf):
    df, noise = selection.noise_columns(quality(spark, sf), KEYS)
    found = _importance(df, [*QUALITY_NUMBERS, *noise, *QUALITY_CATEGORIES])
    return selection.noise_threshold(found, noise).withColumn("importance", F.round("importance", 6))


@query("prune_staged")
def prune_staged(spark, sf):
    df = stored_quality(spark, sf)
    return selection.selected_frame(df, selection.prune_staged(df, KEYS, LABEL, QUALITY_FEATURES))


def _sequential(spark, sf, direction, metric="auc"):
    df = stored_quality(spark, sf)
    steps = selection.select_sequentially(df, KEYS, LABEL, QUALITY_FEATURES, direction, metric=metric)
    frame = spark.createDataFrame(steps, f"step int, feature string, {metric} double")
    return frame.withColumn(metric, F.round(metric, 6))


def _steps_sql(direction, metric="auc"):
    return sequential_sql(SPLIT_SQL, KEYS, LABEL, QUALITY_NUMBERS, QUALITY_CATEGORIES, 3, direction, metric)


@query("sfs_forward", _steps_sql("forward"))
def sfs_forward(spark, sf):
    return _sequential(spark, sf, "forward")


@query("sfs_backward", _steps_sql("backward"))
def sfs_backward(spark, sf):
    return _sequential(spark, sf, "backward")


@query("sfs_forward_accuracy", _steps_sql("forward", "accuracy"))
def sfs_forward_accuracy(spark, sf):
    return _sequential(spark, sf, "forward", "accuracy")


@query("sfs_backward_log_loss", _steps_sql("backward", "neg_log_loss"))
def sfs_backward_log_loss(spark, sf):
    return _sequential(spark, sf, "backward", "neg_log_loss")


@query("prune_staged_accuracy")
def prune_staged_accuracy(spark, sf):
    df = stored_quality(spark, sf)
    return selection.selected_frame(df, selection.prune_staged(df, KEYS, LABEL, QUALITY_FEATURES, metric="accuracy"))
