"""MLlib scorers: boosted trees and logistic regression, one distributed fit per fold.

Categories never reach a model as numbers. Trees get nominal codes, numbered from the training
rows of each fold; logistic regression gets hashed one-hot vectors, which need no vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from columnwright.functions.missing import finite
from columnwright.operators import bayes
from columnwright.operators.joins import lookup_join
from columnwright.operators.metrics import auc
from columnwright.operators.splits import kfold, split_stratified, training_folds
from columnwright.storage import scratch, store

# Values of a category that a fold's trees tell apart. The rest, rare ones, shares one code.
TOP_VALUES = 255
# A value of a single training row tells a tree nothing that holds for other rows.
MIN_ROWS = 2
# Slots of the one-hot vectors of logistic regression. Every step of its fit moves that many
# numbers, and values that meet in a slot share a weight.
HASH_SLOTS = 1 << 12
# Bins of numbers; categories widen it up to TOP_VALUES + 1.
BINS = 32


def gbt(seed: int = 42, bins: int = BINS) -> Estimator:
    return GBTClassifier(
        featuresCol="__features", labelCol="__y", maxIter=20, maxDepth=5, maxBins=bins, seed=seed,
        cacheNodeIds=False,
    )


def lr(seed: int = 42, bins: int = BINS) -> Estimator:
    return LogisticRegression(featuresCol="__features", labelCol="__y", maxIter=20, regParam=0.01)


ESTIMATORS: dict[str, Callable[[int, int], Estimator]] = {"gbt": gbt, "lr": lr}


@dataclass(frozen=True)
class Matrix:
    """Keys, fold, ``__y`` and the features of a table, ready for one scorer.

    Numbers are doubles with 0 for missing. A category is a hash of its text (``lr``), or a number
    that ``codes[feature][fold]`` turns into the code that the trees of that fold know (``gbt``).
    """

    df: DataFrame
    categories: tuple[str, ...]
    codes: Mapping[str, Sequence[Sequence[int]]]
    scorer: str


def text_hash(feature: str) -> Column:
    """Name of a category's value, of one width however long its text; NULL stays NULL."""
    return F.md5(F.col(feature).cast("string"))


def training_values(
    df: DataFrame, features: Sequence[str], fold: str, k: int,
    top: int = TOP_VALUES, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(feature, fold, value, rows, code): the values that the model of each fold knows.

    Values are named by ``text_hash``. ``rows`` are those outside the fold, so nothing of the
    validation rows is seen. The ``top`` values by rows (then by name) with ``min_rows`` at least
    have codes from 1. One count per (feature, value) serves all folds, and each task keeps its
    own ``top`` before the ranking, so the result has at most ``top`` rows per feature and fold.
    """
    named = F.array(*[F.struct(F.lit(f).alias("feature"), text_hash(f).alias("value")) for f in features])
    cells = df.select(fold, F.inline(named)).where("value IS NOT NULL")
    counts = cells.groupBy("feature", "value").agg(
        F.array(*[F.count_if(~F.col(fold).eqNullSafe(F.lit(i))) for i in range(k)]).alias("outside")
    )
    rows = counts.select("feature", "value", F.posexplode("outside").alias("fold", "rows"))
    order = Window.partitionBy("feature", "fold").orderBy(F.desc("rows"), "value")
    return (
        rows.where(F.col("rows") >= min_rows)
        .withColumn("code", F.row_number().over(order)).where(F.col("code") <= top)
    )


def feature_matrix(
    df: DataFrame, keys: Sequence[str], label: str, features: Sequence[str], fold: str, k: int, scorer: str
) -> Matrix:
    """The stored matrix of a table with folds. It belongs to the ``scratch`` block around it."""
    categories = tuple(f for f in features if not isinstance(df.schema[f].dataType, T.NumericType))
    numbers = [f for f in features if f not in categories]
    out = df.select(
        *keys, fold, F.col(label).cast("double").alias("__y"),
        *[F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in numbers],
        *[text_hash(f).alias(f) for f in categories],
    )
    codes: dict[str, list[list[int]]] = {}
    if scorer == "gbt" and categories:
        # At most TOP_VALUES rows per feature and fold.
        known: dict[str, dict[str, dict[int, int]]] = {f: {} for f in categories}
        for r in training_values(df, categories, fold, k).collect():
            known[r["feature"]].setdefault(r["value"], {})[r["fold"]] = r["code"]
        for f in categories:
            values = sorted(known[f])
            codes[f] = [[0, *(known[f][v].get(i, 0) for v in values)] for i in range(k)]
            numbered = df.sparkSession.createDataFrame(
                [(v, n) for n, v in enumerate(values, 1)], f"`{f}` string, __n int"
            )
            out = lookup_join(out, numbered, [f], small=True)
            out = out.withColumn(f, F.coalesce("__n", F.lit(0))).drop("__n")
    return Matrix(store(out, "matrix").df, categories, codes, scorer)


def _nominal(feature: str, codes: Sequence[int]) -> Column:
    """The code of a stored number, marked so that trees split on sets of values."""
    values = ", ".join(str(c) for c in codes)
    code = F.element_at(F.expr(f"array({values})"), F.col(feature) + 1).cast("double")
    # Two values at least, as a nominal attribute needs.
    return code.alias(feature, metadata={"ml_attr": {"type": "nominal", "num_vals": max(max(codes) + 1, 2)}})


def fit_score(matrix: Matrix, features: Sequence[str], fold: str, i: int, seed: int = 42) -> DataFrame:
    """Fit on the rows outside fold ``i``, give the fold's rows the probability of class 1."""
    categories = [f for f in features if f in matrix.categories]
    numbers = [f for f in features if f not in matrix.categories]
    rest = [c for c in matrix.df.columns if c not in categories]
    view, stages, bins = matrix.df, [], BINS
    if matrix.scorer == "gbt":
        coded = {f: matrix.codes[f][i] for f in categories}
        view = view.select(*rest, *[_nominal(f, coded[f]) for f in categories])
        bins = max([BINS, *(max(c) + 1 for c in coded.values())])
        inputs = list(features)
    else:
        inputs = list(numbers)
        if categories:
            stages.append(FeatureHasher(inputCols=categories, outputCol="__hashed", numFeatures=HASH_SLOTS))
            inputs.append("__hashed")
    stages += [VectorAssembler(inputCols=inputs, outputCol="__features"), ESTIMATORS[matrix.scorer](seed, bins)]
    model = Pipeline(stages=stages).fit(view.where(F.col(fold) != i))
    return model.transform(view.where(F.col(fold) == i)).withColumn(
        "__score", vector_to_array("probability")[1]
    )


def mllib_cv_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    k: int = 5,
    test_size: float = 0.2,
    seed: int = 42,
    scorer: str = "gbt",
) -> DataFrame:
    """(fold, auc) on the training part of the stratified split."""
    folded, _ = training_folds(df, keys, label, k, test_size, seed)
    return scored_folds(folded, keys, label, features, "fold", k, scorer, seed)


def scored_folds(
    folded: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    fold: str,
    k: int,
    scorer: str,
    seed: int = 42,
) -> DataFrame:
    """(fold, auc) on a table with folds; its feature matrix is written once."""
    with scratch():
        matrix = feature_matrix(folded, keys, label, features, fold, k, scorer)
        return fold_scores(matrix, features, fold, k, seed)


def kfold_auc_all(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    k: int = 5,
    seed: int = 42,
    scorer: str = "nb",
) -> DataFrame:
    """k-fold AUC over all rows by the named scorer."""
    if scorer == "nb":
        return bayes.kfold_auc_all(df, keys, label, features, k, seed)
    if scorer in ESTIMATORS:
        return scored_folds(kfold(df, keys, k, seed), keys, label, features, "fold", k, scorer, seed)
    raise ValueError(f"unknown scorer: {scorer!r}")


def holdout_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    scorer: str = "nb",
) -> DataFrame:
    """AUC on the holdout of a model fitted on the training part, by the named scorer."""
    if scorer == "nb":
        return bayes.holdout_auc(df, keys, label, features, test_size, seed)
    if scorer in ESTIMATORS:
        marked = split_stratified(df, keys, label, test_size, seed, "__test")
        split = marked.withColumn("fold", F.when(F.col("__test"), F.lit(0)).otherwise(F.lit(1)))
        return scored_folds(split, keys, label, features, "fold", 1, scorer, seed).select("auc")
    raise ValueError(f"unknown scorer: {scorer!r}")


def fold_scores(matrix: Matrix, features: Sequence[str], fold: str, k: int, seed: int = 42) -> DataFrame:
    """(fold, auc) of one model per fold on a stored feature matrix."""
    rows = []
    for i in range(k):
        made = fit_score(matrix, features, fold, i, seed)
        rows.append((i, auc(made, "__y", F.round("__score", 9)).first()["auc"]))
    return matrix.df.sparkSession.createDataFrame(rows, "fold int, auc double")


def cv_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    k: int = 5,
    test_size: float = 0.2,
    seed: int = 42,
    scorer: str = "nb",
) -> DataFrame:
    """k-fold AUC by the named scorer: ``nb``, ``gbt`` or ``lr``."""
    if scorer == "nb":
        return bayes.cv_auc(df, keys, label, features, k, test_size, seed)
    if scorer in ESTIMATORS:
        return mllib_cv_auc(df, keys, label, features, k, test_size, seed, scorer)
    raise ValueError(f"unknown scorer: {scorer!r}")
