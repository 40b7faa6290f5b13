"""Naive Bayes scorer whose models for all folds come from one count of the table.

Every feature is discrete: a category value, or the bin of a number. What the model of
a fold was trained on is the total count minus the count inside the fold, so ``k`` models
need one shuffle of (feature, value) counts. A row's score is a sum of one weight per
feature, in whole thousandths: the sum is the same in any order and on any cluster, and
scores fold into few distinct values before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from columnwright.functions.binning import edges_crossed
from columnwright.functions.hashing import row_hash
from columnwright.functions.missing import finite
from columnwright.operators.joins import BROADCAST_BYTES, lookup_join
from columnwright.operators.metrics import NARROW_LEVELS, auc
from columnwright.operators.ordering import HashOrder, discrete_quantiles, fold_quantiles
from columnwright.operators.splits import kfold, split_stratified, training_folds
from columnwright.storage import scratch, store

BINS = 8
# Weights are whole thousandths: sums are exact, and there are few distinct scores to count.
UNIT = 1_000
# A vocabulary up to this size is sent to every executor, a bigger one is shuffled.
SMALL_VOCABULARY = 200_000


def _numbers(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if isinstance(df.schema[n].dataType, T.NumericType)]


def _reading(name: str, impute: bool) -> Column:
    column = finite(F.col(name).cast("double"))
    return F.coalesce(column, F.lit(0.0)) if impute else column


def numeric_edges(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = BINS,
    impute: bool = True,
    n: int | None = None,
) -> dict[str, list[float]]:
    """Inner bin edges per column: exact discrete quantiles of all rows. Labels play no part."""
    if not columns:
        return {}
    read = df.select(*[_reading(c, impute).alias(f"c{i}") for i, c in enumerate(columns)])
    return {c: sorted(set(q)) for c, q in zip(columns, discrete_quantiles(read, bins, n=n))}


def fold_edges(
    df: DataFrame, columns: Sequence[str], fold: str, k: int, bins: int = BINS, impute: bool = True
) -> dict[str, list[list[float]]]:
    """Inner bin edges per column and fold, from the rows that the fold's model is trained on.

    Exact discrete quantiles of the rows outside the fold (rows without a fold are always
    outside); the passes over the table are those of one set of edges.
    """
    if not columns:
        return {}
    read = df.select(F.col(fold).alias("__fold"), *[_reading(c, impute).alias(f"c{i}") for i, c in enumerate(columns)])
    found = fold_quantiles(read, "__fold", k, bins)
    return {c: [sorted(set(q)) for q in folds] for c, folds in zip(columns, found)}


def edge_table(edges: dict[str, list[list[float]]], k: int) -> list[tuple[str, int, int, float]]:
    """(feature, fold, place, edge) of every edge."""
    return [(c, j, i, e) for c, folds in edges.items() for j in range(k) for i, e in enumerate(folds[j])]


@dataclass(frozen=True)
class Weighted:
    """One row per scored table row: keys, label, fold, and a weight column per feature."""

    df: DataFrame
    keys: list[str]
    label: str
    fold: str
    columns: dict[str, str] = field(default_factory=dict)
    # Rows the weights were counted on, an upper bound of the scored rows.
    rows: int = 0

    def total(self, features: Sequence[str] | None = None) -> Column:
        names = list(self.columns) if features is None else features
        return reduce(lambda a, b: a + b, [F.col(self.columns[f]) for f in names], F.lit(0).cast("bigint"))


def weigh(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    fold: str,
    k: int,
    features: Sequence[str],
    impute: bool = True,
    bins: int = BINS,
    edges: dict[str, list[float]] | str | None = None,
    n: int | None = None,
) -> Weighted:
    """Attach each row's weights under the model of its own fold.

    Folds are 0..k-1. Rows with a NULL fold only train. The label is 0/1. A value that
    the training rows of a fold do not hold weighs nothing. ``n`` is the number of rows,
    if it is known. ``edges`` are shared by all folds, or ``"per_fold"``: then every model bins
    numbers by the quantiles of its own training rows. Rows are counted in the bins that the
    edges of all folds make together, and a model adds up the ones inside each of its bins.
    """
    numbers = _numbers(df, features)
    by_fold: dict[str, list[list[float]]] = {}
    if edges is None:
        edges = numeric_edges(df, numbers, bins, impute, n)
    elif edges == "per_fold":
        by_fold = fold_edges(df, numbers, fold, k, bins, impute)
        edges = {c: sorted(set().union(*folds)) for c, folds in by_fold.items()}
    codes = {f: f"__v{i}" for i, f in enumerate(features)}
    coded = df.where(F.col(label).isNotNull()).select(
        *keys,
        F.col(label).cast("int").alias(label),
        F.col(fold).cast("int").alias(fold),
        *[
            (
                edges_crossed(_reading(f, impute), edges[f]) if f in edges else F.col(f).cast("string")
            ).alias(codes[f])
            for f in features
        ],
    )
    counts = _count_values(coded, label, fold, k, codes)
    per_feature = {
        r["feature"]: r
        for r in counts.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"),
            *[F.sum(c).alias(c) for c in _count_names(k)],
        )
        .collect()
    }
    weights = _weights(counts, per_feature, k)

    of_numbers = F.col("feature").isin([codes[f] for f in numbers])
    if by_fold:
        merged = _merged_counts(counts.where(of_numbers), {codes[f]: (edges[f], by_fold[f]) for f in numbers}, k)
        small = _fold_weights(merged, {codes[f]: (edges[f], by_fold[f]) for f in numbers}, k)
    else:
        # At most one row per bin of a number.
        small = {(r["feature"], r["value"]): r["w"] for r in weights.where(of_numbers).collect()}
    out = coded.where(F.col(fold).isNotNull())
    columns = {f: f"__w{i}" for i, f in enumerate(features)}
    at_fold = lambda w: F.get(w, F.col(fold))
    ready: dict[str, Column] = {}
    for f in features:
        code, name = codes[f], columns[f]
        if f in edges:
            size = len(edges[f]) + 1
            table = [small.get((code, v), [0] * k) for v in [None, *map(str, range(size))]]
            rows = ", ".join("array(" + ", ".join(f"{int(x)}L" for x in w) + ")" for w in table)
            literal = F.expr(f"array({rows})")
            spot = F.coalesce(F.col(code) + 1, F.lit(0))
            ready[name] = F.coalesce(at_fold(F.get(literal, spot)), F.lit(0))
        else:
            vocabulary = weights.where(F.col("feature") == code).select(
                F.col("value").alias(code), F.col("w").alias(f"__a{name}")
            )
            size, text = (per_feature[code][c] if code in per_feature else 0 for c in ("size", "bytes"))
            small_enough = size <= SMALL_VOCABULARY and text + 8 * k * size <= BROADCAST_BYTES
            out = lookup_join(out, vocabulary, [code], small=small_enough)
            ready[name] = F.coalesce(at_fold(F.col(f"__a{name}")), F.lit(0))
    out = out.select(*keys, label, fold, *[c.cast("bigint").alias(n) for n, c in ready.items()])
    rows = max((r["pos"] + r["neg"] for r in per_feature.values()), default=0)
    return Weighted(out, list(keys), label, fold, columns, rows)


def _count_names(k: int) -> list[str]:
    return ["pos", "neg", *[f"pos{i}" for i in range(k)], *[f"neg{i}" for i in range(k)]]


def _count_values(
    coded: DataFrame, label: str, fold: str, k: int, codes: dict[str, str]
) -> DataFrame:
    """Rows per (feature, value) and class, in all and inside each fold."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in codes.values()])
    long = coded.select(F.col(label).alias("y"), F.col(fold).alias("f"), F.inline(pairs))
    # First per fold, so that one task never sees more of a value than its own share.
    by_fold = long.groupBy("feature", "value", "f").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")
    )
    inside = lambda c, i: F.coalesce(F.sum(F.when(F.col("f") == i, F.col(c))), F.lit(0))
    counted = by_fold.groupBy("feature", "value").agg(
        F.sum("p").alias("pos"),
        F.sum("n").alias("neg"),
        *[inside("p", i).alias(f"pos{i}") for i in range(k)],
        *[inside("n", i).alias(f"neg{i}") for i in range(k)],
    )
    return store(counted, "value-counts").df


def _merged_counts(counts: DataFrame, bins: dict, k: int) -> dict[tuple[str, int], dict[object, tuple[int, int, bool]]]:
    """Per (feature, fold): bin of that fold's own edges -> training rows of both classes, from counts
    in the common bins. There are at most ``k`` times as many of those as of the fold's own."""
    out: dict[tuple[str, int], dict[object, tuple[int, int]]] = {}
    for r in counts.collect():
        common, folds = bins[r["feature"]]
        for j in range(k):
            own = None if r["value"] is None else sum(e in folds[j] for e in common[: int(r["value"])])
            p, n = out.setdefault((r["feature"], j), {}).get(own, (0, 0))
            out[r["feature"], j][own] = (p + r["pos"] - r[f"pos{j}"], n + r["neg"] - r[f"neg{j}"])
    return out


def _fold_weights(merged: dict, bins: dict, k: int) -> dict[tuple[str, str | None], list[int]]:
    """(feature, common bin) -> weight under each fold's model, as ``_weights`` defines it."""
    out: dict[tuple[str, str | None], list[int]] = {}
    for feature, (common, folds) in bins.items():
        for value in [None, *range(len(common) + 1)]:
            row = []
            for j in range(k):
                counted = merged.get((feature, j), {})
                own = None if value is None else sum(e in folds[j] for e in common[:value])
                p, n = counted.get(own, (0, 0))
                all_p, all_n = (sum(x[i] for x in counted.values()) for i in (0, 1))
                odds = math.log((p + 1) / (all_p + len(counted))) - math.log((n + 1) / (all_n + len(counted))) if p + n else 0.0
                row.append(math.floor(abs(odds) * UNIT + 0.5) * (1 if odds > 0 else -1))
            out[feature, None if value is None else str(value)] = row
    return out


def _weights(counts: DataFrame, per_feature: dict, k: int) -> DataFrame:
    """(feature, value, w): log odds of the value under each fold's training rows, with
    one added to every count."""
    if not per_feature:
        return counts.select("feature", "value", F.array().cast("array<bigint>").alias("w"))
    any_feature = next(iter(per_feature.values()))
    sizes = F.create_map(*[x for f, r in per_feature.items() for x in (F.lit(f), F.lit(r["size"]))])
    size = F.element_at(sizes, F.col("feature"))
    per_fold = []
    for i in range(k):
        p, n = F.col("pos") - F.col(f"pos{i}"), F.col("neg") - F.col(f"neg{i}")
        all_p = any_feature["pos"] - any_feature[f"pos{i}"]
        all_n = any_feature["neg"] - any_feature[f"neg{i}"]
        odds = F.ln((p + 1) / (F.lit(all_p) + size)) - F.ln((n + 1) / (F.lit(all_n) + size))
        per_fold.append(
            F.when(p + n > 0, F.round(odds * F.lit(float(UNIT))).cast("bigint")).otherwise(F.lit(0))
        )
    return counts.select("feature", "value", F.array(*per_fold).alias("w"))


def scored(weighted: Weighted, features: Sequence[str] | None = None) -> DataFrame:
    """Label, fold and score of every scored row."""
    return weighted.df.select(
        *weighted.keys, weighted.label, weighted.fold, weighted.total(features).alias("score")
    )


def fold_auc(weighted: Weighted, features: Sequence[str] | None = None) -> DataFrame:
    """(fold, auc)."""
    return auc(
        weighted.df, weighted.label, weighted.total(features), [weighted.fold], levels=NARROW_LEVELS
    ).orderBy(weighted.fold)


def cv_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    k: int = 5,
    test_size: float = 0.2,
    seed: object = 42,
    edges: str | None = None,
) -> DataFrame:
    """k-fold AUC on the training part of the stratified split; missing numbers count as 0.

    With ``edges="per_fold"`` the bins of numbers come from the training rows of each fold.

    Split, folds, edges, counts and scores are passes over the table, so its columns and the
    hash that orders its rows are written once.
    """
    with scratch():
        table = store(df.select(*keys, label, *features, row_hash(keys, seed).alias("__order")), "cv").df
        order = HashOrder(table, keys, seed, stratum=label, hashed="__order")
        folded, n = training_folds(table, keys, label, k, test_size, seed, order=order)
        made = fold_auc(weigh(folded, keys, label, "fold", k, features, edges=edges, n=n))
        return store(made, "fold-auc", lasting=True).df


def holdout_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    test_size: float = 0.2,
    seed: object = 42,
) -> DataFrame:
    """AUC on the holdout of a model fitted on the training part."""
    marked = split_stratified(df, keys, label, test_size, seed, "__test")
    train = marked.where(~F.col("__test"))
    edges = numeric_edges(train, _numbers(df, features))
    split = marked.withColumn("fold", F.when(F.col("__test"), F.lit(0))).drop("__test")
    weighted = weigh(split, keys, label, "fold", 1, features, edges=edges)
    return auc(weighted.df, label, weighted.total(), levels=NARROW_LEVELS)


def kfold_auc_all(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    k: int = 5,
    seed: object = 42,
) -> DataFrame:
    """k-fold AUC over all rows; a missing value is a value of its own."""
    folded = kfold(df, keys, k, seed)
    return fold_auc(weigh(folded, keys, label, "fold", k, features, impute=False))
