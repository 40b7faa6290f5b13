"""Metrics and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import (
    LINE_CATEGORIES, LINE_FEATURES, LINE_KEYS, LINE_NUMBERS, LINES_SQL, QUALITY_CATEGORIES,
    QUALITY_FEATURES, QUALITY_KEYS, QUALITY_NUMBERS, QUALITY_SQL, auc_sql, best_accuracy_sql, edges_sql,
    kfold_rows_sql, lines, nb_fold_auc_sql, neg_log_loss_sql, quality, stored_quality, stratified_split_sql, table, weights_sql,
)
from columnwright.catalog.registry import query
from columnwright.operators import bayes, ledger, metrics, splits, trees

KEYS, LABEL, FOLDS = QUALITY_KEYS, "quality", 5


def _rounded(df):
    return df.withColumn("auc", F.round("auc", 6))


def _rounded_sql(sql):
    return f"SELECT * REPLACE (round(auc, 6) AS auc) FROM ({sql})"


SCORE_SQL = f"SELECT quality AS y, letter_share AS score FROM ({QUALITY_SQL})"


@query("auc_exact", _rounded_sql(auc_sql(SCORE_SQL)))
def auc_exact(spark, sf):
    return _rounded(metrics.auc(quality(spark, sf), LABEL, "letter_share"))


LINE_SCORE_SQL = "SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_quantity AS BIGINT) * 7 - l_suppkey % 50 AS score FROM lineitem"


@query("accuracy_best_threshold", f"SELECT l_linestatus, round(a.accuracy, 6) AS accuracy, round(l.neg_log_loss, 6) AS neg_log_loss FROM ({best_accuracy_sql(LINE_SCORE_SQL, ['l_linestatus'])}) a JOIN ({neg_log_loss_sql(LINE_SCORE_SQL, ['l_linestatus'])}) l USING (l_linestatus)")
def accuracy_best_threshold(spark, sf):
    rows = lines(spark, sf).withColumn("score", F.col("l_quantity").cast("bigint") * 7 - F.col("l_suppkey") % 50)
    by = ["l_linestatus"]
    best = metrics.best_accuracy(rows, "returned", "score", by).withColumn("accuracy", F.round("accuracy", 6))
    loss = metrics.neg_log_loss(rows, "returned", "score", by).withColumn("neg_log_loss", F.round("neg_log_loss", 6))
    return best.join(loss, by)


@query("auc_per_fold", _rounded_sql(auc_sql(
    f"SELECT quality AS y, fold, letter_share AS score "
    f"FROM ({kfold_rows_sql(QUALITY_SQL, KEYS, FOLDS)})", ["fold"])))
def auc_per_fold(spark, sf):
    folded = splits.kfold(stored_quality(spark, sf), KEYS, FOLDS)
    return _rounded(metrics.auc(folded, LABEL, "letter_share", ["fold"]))


@query("accuracy", f"""
    SELECT lang, round(avg(CASE WHEN quality = CAST(letter_share > 0.78 AS INTEGER) THEN 1.0 ELSE 0.0 END), 6) AS score
    FROM ({QUALITY_SQL}) GROUP BY 1""")
def accuracy(spark, sf):
    guessed = quality(spark, sf).withColumn("guess", (F.col("letter_share") > 0.78).cast("int"))
    scored = metrics.score_by(guessed, metrics.accuracy, LABEL, "guess", ["lang"])
    return scored.withColumn("score", F.round("score", 6))


def train_sql(source, keys, label):
    return f"SELECT * EXCLUDE (is_test) FROM ({stratified_split_sql(source, keys, label)}) WHERE NOT is_test"


def cv_sql(numbers, categories, k=FOLDS):
    folded = kfold_rows_sql(train_sql(QUALITY_SQL, KEYS, LABEL), KEYS, k)
    return nb_fold_auc_sql(folded, KEYS, LABEL, numbers, categories, k)


@query("cv_auc_nb", _rounded_sql(cv_sql(QUALITY_NUMBERS, QUALITY_CATEGORIES)))
def cv_auc_nb(spark, sf):
    return _rounded(bayes.cv_auc(stored_quality(spark, sf), KEYS, LABEL, QUALITY_FEATURES, FOLDS))


@query("cv_auc_nb_lines", _rounded_sql(nb_fold_auc_sql(
    kfold_rows_sql(train_sql(LINES_SQL, LINE_KEYS, "returned"), LINE_KEYS, FOLDS),
    LINE_KEYS, "returned", LINE_NUMBERS, LINE_CATEGORIES, FOLDS)))
def cv_auc_nb_lines(spark, sf):
    return _rounded(bayes.cv_auc(lines(spark, sf), LINE_KEYS, "returned", LINE_FEATURES, FOLDS))


def per_fold_sql(folded, numbers, categories, k=FOLDS):
    """Each fold scored on its own, with the edges of the rows outside it."""
    parts = []
    for j in range(k):
        marked = f"SELECT * REPLACE (CASE WHEN fold = {j} THEN 0 END AS fold) FROM ({folded})"
        ctes = weights_sql(marked, KEYS, LABEL, numbers, categories, 1, edges=edges_sql("SELECT * FROM folded WHERE fold IS NULL", numbers))
        parts.append(f"SELECT {j} AS fold, auc FROM (WITH {ctes} SELECT auc FROM ({auc_sql('SELECT row_id, any_value(y) AS y, sum(w) AS score FROM rw GROUP BY row_id')}))")
    return f"SELECT CAST(fold AS INTEGER) AS fold, auc FROM ({' UNION ALL '.join(parts)})"


TRAIN_FOLDS_SQL = kfold_rows_sql(train_sql(QUALITY_SQL, KEYS, LABEL), KEYS, FOLDS)


@query("cv_auc_nb_fold_edges", _rounded_sql(per_fold_sql(TRAIN_FOLDS_SQL, QUALITY_NUMBERS, QUALITY_CATEGORIES)))
def cv_auc_nb_fold_edges(spark, sf):
    df = stored_quality(spark, sf)
    return _rounded(bayes.cv_auc(df, KEYS, LABEL, QUALITY_FEATURES, FOLDS, edges="per_fold"))


STEPS_SQL = ", ".join(str(i / 8) for i in range(1, 8))


@query("fold_edges", "SELECT feature, fold, CAST(row_number() OVER (PARTITION BY feature, fold ORDER BY edge) - 1 AS INTEGER) AS place, edge FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS feature, CAST({j} AS INTEGER) AS fold, unnest(quantile_disc(CAST(coalesce({c}, 0) AS DOUBLE), [{STEPS_SQL}])) AS edge FROM ({kfold_rows_sql(LINES_SQL, LINE_KEYS, 3)}) WHERE fold <> {j}"
    for c in LINE_NUMBERS for j in range(3)) + ")")
def fold_edges(spark, sf):
    """Edges of the numbers of all lines, for the training rows of each of three folds."""
    folded = splits.kfold(lines(spark, sf), LINE_KEYS, 3)
    found = bayes.fold_edges(folded, LINE_NUMBERS, "fold", 3)
    return spark.createDataFrame(bayes.edge_table(found, 3), "feature string, fold int, place int, edge double")


@query("kfold_auc_all", _rounded_sql(nb_fold_auc_sql(
    kfold_rows_sql(QUALITY_SQL, KEYS, FOLDS), KEYS, LABEL, QUALITY_NUMBERS, QUALITY_CATEGORIES, FOLDS, impute=False)))
def kfold_auc_all(spark, sf):
    return _rounded(bayes.kfold_auc_all(stored_quality(spark, sf), KEYS, LABEL, QUALITY_FEATURES, FOLDS))


def _holdout_sql():
    marked = stratified_split_sql(QUALITY_SQL, KEYS, LABEL)
    folded = f"SELECT *, CASE WHEN is_test THEN 0 END AS fold FROM ({marked})"
    edges = edges_sql("SELECT * FROM folded WHERE fold IS NULL", QUALITY_NUMBERS)
    ctes = weights_sql(folded, KEYS, LABEL, QUALITY_NUMBERS, QUALITY_CATEGORIES, 1, edges=edges)
    scored = "SELECT row_id, any_value(y) AS y, sum(w) AS score FROM rw GROUP BY row_id"
    return f"WITH {ctes} SELECT auc FROM ({auc_sql(scored)})"


@query("holdout_auc_nb", _rounded_sql(_holdout_sql()))
def holdout_auc_nb(spark, sf):
    return _rounded(bayes.holdout_auc(stored_quality(spark, sf), KEYS, LABEL, QUALITY_FEATURES))


STEPS = {
    "before": (["n_chars"], ["lang"]),
    "added": (QUALITY_NUMBERS, QUALITY_CATEGORIES),
    "pruned": (["letter_share", "unique_share"], []),
}


@query("round_compare", "SELECT " + ", ".join(
    f"(SELECT round(avg(auc), 6) FROM ({cv_sql(*STEPS[s])})) AS score_{s}" for s in STEPS))
def round_compare(spark, sf):
    df = stored_quality(spark, sf)
    train, _ = splits.training_folds(df, KEYS, LABEL, FOLDS)
    weighted = bayes.weigh(train, KEYS, LABEL, "fold", FOLDS, QUALITY_FEATURES)
    # A weight depends on its own feature only, so one weighing serves every feature set.
    scores = None
    for step, (numbers, categories) in STEPS.items():
        part = bayes.fold_auc(weighted, [*numbers, *categories]).select(
            F.lit(step).alias("step"), F.col("auc").alias("score")
        )
        scores = part if scores is None else scores.unionByName(part)
    return ledger.compare_scores(scores).select(
        *[F.round(c, 6).alias(c) for c in ("score_before", "score_added", "score_pruned")]
    )


TREE_CATEGORIES = ["l_linestatus", "l_returnflag", "l_shipdate", "l_suppkey"]


@query("training_values", " UNION ALL ".join(f"""
    SELECT feature, CAST({i} AS INTEGER) AS fold, value, rows, CAST(code AS INTEGER) AS code FROM (
      SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rows DESC, value) AS code FROM (
        SELECT feature, md5(CAST(v AS VARCHAR)) AS value, count(*) AS rows
        FROM (SELECT l_orderkey, '{c}' AS feature, {c} AS v FROM lineitem) WHERE l_orderkey % 4 <> {i} AND v IS NOT NULL
        GROUP BY ALL) WHERE rows >= 2) WHERE code <= 255""" for i in range(4) for c in TREE_CATEGORIES))
def training_values(spark, sf):
    """Category values that the trees of four folds know, over all lines; folds keep an order whole."""
    folded = table(spark, sf, "lineitem").withColumn("fold", (F.col("l_orderkey") % 4).cast("int"))
    return trees.training_values(folded, TREE_CATEGORIES, "fold", 4)


@query("cv_auc_gbt")
def cv_auc_gbt(spark, sf):
    return trees.cv_auc(stored_quality(spark, sf), KEYS, LABEL, QUALITY_FEATURES, 3, scorer="gbt")


@query("cv_auc_lr")
def cv_auc_lr(spark, sf):
    return trees.cv_auc(stored_quality(spark, sf), KEYS, LABEL, QUALITY_FEATURES, 3, scorer="lr")
