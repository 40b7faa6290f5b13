"""Feature selection: useless features, permutation importance, staged pruning, votes, SFS."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from columnwright.functions.hashing import hash_uniform, row_hash
from columnwright.operators.bayes import Weighted, weigh
from columnwright.operators.joins import BROADCAST_BYTES, lookup_join
from columnwright.operators.metrics import NARROW_LEVELS, WORST, metric_named
from columnwright.operators.ordering import MAX_RANGES, HashOrder
from columnwright.operators.splits import repeated_stratified_kfold, stored_stratified_kfold
from columnwright.storage import scratch, store

PERMUTE_SEED = "permute"
NOISE_SEED = "noise"
# Rows that one task orders; the order of a bigger table is cut into ranges.
RANGE_ROWS = 200_000
BASE = "__base"
PLAIN = "__plain"


# ---------------------------------------------------------------- useless features

def useless_features(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], split: str | None = None
) -> dict[object, list[str]]:
    """Per split, the features that cannot help a model of its training rows: one value
    only, or equal to an earlier feature.

    One aggregate pass: extremes and missing counts can be combined over the other splits,
    and so can the XOR of (row, value) hashes that marks equal columns. Marked pairs are
    then compared value by value.
    """
    group = [split] if split else []
    stats = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            agg
            for i, f in enumerate(features)
            for agg in (
                F.count_if(F.col(f).isNull()).alias(f"z{i}"),
                F.min(F.col(f).cast("string")).alias(f"lo{i}"),
                F.max(F.col(f).cast("string")).alias(f"hi{i}"),
                F.bit_xor(F.xxhash64(*keys, F.col(f).cast("string"))).alias(f"x{i}"),
            )
        ],
    ).collect()
    splits = [r[split] for r in stats] if split else [None]
    out: dict[object, list[str]] = {}
    twins: dict[object, list[tuple[int, int]]] = {}
    for s in sorted(splits, key=str):
        train = [r for r in stats if not split or r[split] != s] or stats
        n = sum(r["n"] for r in train)
        constant = []
        for i in range(len(features)):
            missing = sum(r[f"z{i}"] for r in train)
            values = {r[c] for r in train for c in (f"lo{i}", f"hi{i}") if r[c] is not None}
            if missing == n or (missing == 0 and len(values) == 1):
                constant.append(i)
        mark = [reduce(lambda a, b: a ^ b, [r[f"x{i}"] for r in train]) for i in range(len(features))]
        twins[s] = [
            (i, j) for i, j in combinations(range(len(features)), 2)
            if mark[i] == mark[j] and i not in constant and j not in constant
        ]
        out[s] = [features[i] for i in constant]
    pairs = sorted({p for found in twins.values() for p in found})
    if pairs:
        differs = lambda i, j: ~F.col(features[i]).cast("string").eqNullSafe(
            F.col(features[j]).cast("string")
        )
        rows = df.groupBy(*group).agg(
            *[F.count_if(differs(i, j)).alias(f"d{i}_{j}") for i, j in pairs]
        ).collect()
        for s in out:
            train = [r for r in rows if not split or r[split] != s] or rows
            for i, j in twins[s]:
                if sum(r[f"d{i}_{j}"] for r in train) == 0 and features[j] not in out[s]:
                    out[s].append(features[j])
    return out


# ---------------------------------------------------------------- importance

def noise_columns(df: DataFrame, keys: Sequence[str], n: int = 3) -> tuple[DataFrame, list[str]]:
    """Columns of hash noise, which no useful feature should be beaten by."""
    names = [f"__noise_{i}" for i in range(n)]
    return df.withColumns({c: hash_uniform(keys, NOISE_SEED, i) for i, c in enumerate(names)}), names


def ring_hash(keys: Sequence[str]) -> Column:
    """What ``permute`` orders rows by: the row hash's bytes, and its first twelve digits as a number.

    Bytes are in the order of the digits, in half the room; the number is costly to work out.
    """
    digits = row_hash(keys, PERMUTE_SEED)
    return F.struct(F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint").alias("lead"), F.unhex(digits).alias("bytes"))


def permute(
    weighted: Weighted, rows_per_range: int = RANGE_ROWS, hashed: str | None = None
) -> tuple[Weighted, dict[str, str]]:
    """Add, per feature, the weight of the next row of the same fold in a hash order; the
    last row of a fold is followed by its first.

    Inside one fold a row's weight depends on its value alone, so the neighbour's weight
    is the weight of the permuted value. A table of more than ``rows_per_range`` rows is
    cut into ranges of the leading bytes of its hashes, which are even, so no sample of it is
    needed: ranges are ordered by their own tasks, and the last row of a range gets the first
    row of the next one, which are broadcast. The number of ranges does not change the result.
    ``hashed`` names a key column of a stored table that holds ``ring_hash`` already; else the
    table is written with it.
    """
    fold, names = weighted.fold, {f: f"__p{i}" for i, f in enumerate(weighted.columns)}
    row = F.struct(*[F.col(w).alias(names[f]) for f, w in weighted.columns.items()])
    marked = weighted.df.withColumn("__ring", ring_hash(weighted.keys) if hashed is None else F.col(hashed))
    follower = lambda c, window: F.coalesce(F.lead(c).over(window), F.first(c).over(window))
    most = min(MAX_RANGES, BROADCAST_BYTES // (16 * (len(names) + 2)))
    ranges = min(-(-weighted.rows // rows_per_range), most)
    if ranges <= 1:
        ring = Window.partitionBy(fold).orderBy("__ring")
        out = marked.withColumn("__row", row).withColumn("__next", follower("__row", ring))
    else:
        ready = store(marked, "ring").df if hashed is None else marked
        ranged = ready.select(
            *weighted.df.columns, F.col("__ring.lead").alias("__lead"), F.col("__ring.bytes").alias("__h"),
            F.shiftright(F.col("__ring.lead") * ranges, 48).alias("__range"),
        )
        # Rows that share the least leading bytes of a range are few: the whole hash decides among them.
        least = ranged.groupBy(fold, "__range").agg(F.min("__lead").alias("__lead"))
        heads = (
            ranged.join(F.broadcast(least), [fold, "__range", "__lead"])
            .groupBy(fold, "__range").agg(F.min_by(row, "__h").alias("__head"))
        )
        ring = Window.partitionBy(fold).orderBy("__range")
        borders = heads.select(fold, "__range", follower("__head", ring).alias("__border"))
        within = Window.partitionBy(fold, "__range").orderBy("__lead", "__h")
        out = (
            ranged.repartition(ranges, fold, "__range").withColumn("__row", row)
            .withColumn("__after", F.lead("__row").over(within))
            .join(F.broadcast(borders), [fold, "__range"])
            .withColumn("__next", F.coalesce("__after", "__border"))
        )
    return replace(weighted, df=out.select(*weighted.df.columns, "__next.*")), names


def score_variants(
    weighted: Weighted, variants: Sequence[tuple[str, Column]], rows: DataFrame | None = None, metric: str = "auc"
) -> DataFrame:
    """(fold, variant, auc): every variant of the score on every fold, in one job.

    A variant whose score is NULL on a row is left out there. The last column is named after
    the ``metric``.
    """
    table = weighted.df if rows is None else rows
    # Variants go by number until there is one row for each of them.
    scores = F.posexplode(F.array(*[c.cast("bigint") for _, c in variants])).alias("__variant", "__score")
    long = table.select(weighted.fold, F.col(weighted.label).alias("__label"), scores)
    found = metric_named(metric)(long, "__label", "__score", [weighted.fold, "__variant"], metric, NARROW_LEVELS)
    name = F.get(F.array(*[F.lit(n) for n, _ in variants]), F.col("__variant"))
    return found.select(weighted.fold, name.alias("variant"), metric)


def importance_variants(
    weighted: Weighted, permuted: Mapping[str, str], active: Mapping[object, Sequence[str]],
    noise: Sequence[str] = (), rows: DataFrame | None = None,
) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Rows with scores to compare: all active features, all but noise, and each feature permuted.

    ``active`` lists the features in use per fold; rows of other folds are left out. The sums
    are columns of the rows, so that no variant spells them out again: the JVM does not compile
    a method of more than 8,000 bytes.
    """
    fold = F.col(weighted.fold)
    used = [f for f in weighted.columns if any(f in fs for fs in active.values())]
    where = {f: [s for s, fs in active.items() if f in fs] for f in used}
    on = lambda f, c, other: c if len(where[f]) == len(active) else F.when(fold.isin(where[f]), c).otherwise(other)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    total = lambda fs: reduce(lambda a, b: a + b, [on(f, F.col(weighted.columns[f]), zero) for f in fs], zero)
    table = (weighted.df if rows is None else rows).where(fold.isin(list(active)))
    sums = {BASE: total(used)}
    if noise:
        sums[PLAIN] = total([f for f in used if f not in noise])
    out = [(name, F.col(name)) for name in sums]
    for f in used:
        out.append((f, F.col(BASE) + on(f, F.col(permuted[f]) - F.col(weighted.columns[f]), none)))
    return table.withColumns(sums), out


def permutation_importance(
    weighted: Weighted,
    features: Sequence[str] | None = None,
    rows_per_range: int = RANGE_ROWS,
    metric: str = "auc",
    hashed: str | None = None,
) -> DataFrame:
    """(fold, feature, importance): AUC, or another metric, lost when the feature's values are permuted.

    ``hashed`` is the one of ``permute``.
    """
    names = list(weighted.columns) if features is None else list(features)
    with scratch():
        swapped, permuted = permute(weighted, rows_per_range, hashed)
        folds = [r[0] for r in weighted.df.select(weighted.fold).distinct().collect()]
        rows, variants = importance_variants(swapped, permuted, {s: names for s in folds})
        scores = score_variants(swapped, variants, rows, metric)
        # One score per (fold, feature): bounded by the schema, whatever the table holds.
        scores = store(scores, "scores", lasting=True).df
    base = scores.where(F.col("variant") == BASE).select(weighted.fold, F.col(metric).alias("__base"))
    return (
        scores.where(F.col("variant") != BASE).join(F.broadcast(base), weighted.fold)
        .select(
            weighted.fold, F.col("variant").alias("feature"),
            (F.col("__base") - F.col(metric)).alias("importance"),
        )
    )


def noise_threshold(importance: DataFrame, noise: Sequence[str], fold: str = "fold") -> DataFrame:
    """(fold, feature, importance, keep): keep what beats every noise column of its fold."""
    is_noise = F.col("feature").isin(list(noise))
    bar = importance.where(is_noise).groupBy(fold).agg(F.max("importance").alias("__bar"))
    return lookup_join(importance.where(~is_noise), bar, [fold], small=True).select(
        fold, "feature", "importance", (F.col("importance") > F.col("__bar")).alias("keep")
    )


def prune_round(importance: DataFrame, ratio: float, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Drop the ``ceil(ratio * n)`` least important features of each group."""
    order = Window.partitionBy(*by).orderBy("importance", "feature")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = importance.withColumn("__r", F.row_number().over(order)).withColumn(
        "__drop", F.ceil(F.lit(ratio) * size)
    )
    return ranked.where("__r > __drop").drop("__r", "__drop")


# ---------------------------------------------------------------- staged pruning

class TimeUp(Exception):
    """The jobs of a block were cancelled because its time was over."""


@contextmanager
def time_limit(spark: SparkSession, deadline: float) -> Iterator[None]:
    """Cancel the Spark jobs of this block at ``deadline`` (by ``time.monotonic``) and raise ``TimeUp``.

    Only jobs of this block bear its tag, so nothing else in the session is touched. An error
    that comes for another reason is raised as it is.
    """
    left = deadline - time.monotonic()
    if left <= 0:
        raise TimeUp
    context, tag, over = spark.sparkContext, f"columnwright-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        over.set()
        # A job that starts just now is caught by the next call.
        while not ended.wait(0.2):
            context.cancelJobsWithTag(tag)

    ended = threading.Event()
    timer = threading.Timer(min(left, threading.TIMEOUT_MAX), cancel)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if over.is_set():
            raise TimeUp from error
        raise
    finally:
        timer.cancel()
        ended.set()
        context.removeJobTag(tag)


@dataclass(frozen=True)
class Stage:
    ratio: float
    patience: int
    against_noise: bool = False
    # Rows per split on which importance is measured; None means all.
    rows: int | None = None


# Prune ratios and stopping rounds of the three stages.
STAGES = (Stage(0.075, 3, True), Stage(0.05, 20), Stage(0.025, 40))
# The same with their row limits for measuring importance.
SAMPLED_STAGES = (
    Stage(0.075, 3, True, 10_000),
    Stage(0.05, 20, False, 100_000),
    Stage(0.025, 40, False, 500_000),
)


def prune_staged(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    splitter: Callable[[DataFrame], DataFrame] | None = None,
    stages: Sequence[Stage] = STAGES,
    time_limit_per_split: float = 3600,
    seed: int = 42,
    n_noise: int = 3,
    copy: bool = True,
    on_split: Callable[[int, list[str]], None] | None = None,
    metric: str = "auc",
) -> list[tuple[int, int, str]]:
    """Selected features as (split, position, feature), by three stages of pruning.

    All splits advance together: a round is one job that scores the current set of every
    split on its validation rows and permutes each of its features. Stage by stage, the
    least important share is dropped (first only features that do not beat noise); a set
    is accepted if its validation ``metric`` (AUC by default) is not worse than the best; a stage ends after
    ``patience`` rounds in a row without that. ``splitter`` adds ``split`` (0..k-1).
    The input is written once with its splits; a stored one needs no ``copy``.

    ``on_split(split, features)`` is called as soon as a split is done with the last stage,
    while others go on; ``sinks.write_selected_split`` is made for it. When the time of all
    splits is over, the running round's jobs are cancelled, and every split keeps its best set.
    """
    worst = WORST[metric]
    if splitter is None:
        table = repeated_stratified_kfold(df, keys, label, 3, 1, seed).drop("repeat")
        table = table.withColumnRenamed("fold", "split")
    else:
        table = splitter(df)
    with scratch():
        table, noise = noise_columns(table, keys, n_noise)
        table = table.select(*keys, label, "split", *features, *noise)
        if copy:
            table = store(table, "pruning").df
        splits = sorted(r["split"] for r in table.select("split").distinct().collect())
        useless = useless_features(table, keys, features, "split")
        weighted = weigh(table, keys, label, "split", max(splits) + 1, [*features, *noise])
        swapped, permuted = permute(weighted)
        swapped = replace(swapped, df=store(swapped.df, "weights").df)

        start = {s: [f for f in features if f not in useless[s]] for s in splits}
        best_set, best_score = dict(start), dict.fromkeys(splits, -math.inf)
        deadline = time.monotonic() + time_limit_per_split * len(splits)
        done: set[int] = set()

        def finish(ended: Sequence[int]) -> None:
            for s in ended:
                if s not in done:
                    done.add(s)
                    if on_split is not None:
                        on_split(s, list(best_set[s]))

        seen: dict[tuple, dict[str, float]] = {}
        for number, stage in enumerate(stages):
            rows = swapped.df if stage.rows is None else _cap_per_split(swapped, stage.rows)
            current, misses = dict(best_set), dict.fromkeys(splits, 0)
            open_splits = [s for s in splits if current[s]]
            if number == len(stages) - 1:
                finish([s for s in splits if not current[s]])
            while open_splits and time.monotonic() < deadline:
                extra = noise if stage.against_noise else []
                active = {s: [*current[s], *extra] for s in open_splits}
                # A later stage walks through sets that an earlier one has scored.
                at = {s: (s, stage.rows, *active[s]) for s in open_splits}
                fresh = {s: active[s] for s in open_splits if at[s] not in seen}
                if fresh:
                    summed, variants = importance_variants(swapped, permuted, fresh, extra, rows)
                    try:
                        with time_limit(df.sparkSession, deadline):
                            found_scores = score_variants(swapped, variants, summed, metric).collect()
                    except TimeUp:
                        break
                    seen.update({at[s]: {} for s in fresh})
                    for r in found_scores:
                        seen[at[r["split"]]][r["variant"]] = worst if r[metric] is None else r[metric]
                still_open = []
                for s in open_splits:
                    found = seen[at[s]]
                    base = found.get(BASE, worst)
                    value = found.get(PLAIN if extra else BASE, worst)
                    if value >= best_score[s]:
                        best_set[s], best_score[s], misses[s] = current[s], value, 0
                    else:
                        misses[s] += 1
                    gain = {f: base - found.get(f, worst) for f in active[s]}
                    droppable = sorted(current[s], key=lambda f: (gain[f], current[s].index(f)))
                    if extra:
                        bar = max(gain[f] for f in noise)
                        droppable = [f for f in droppable if gain[f] <= bar]
                    n_drop = min(math.ceil(stage.ratio * len(current[s])), len(current[s]) - 1)
                    dropped = set(droppable[:n_drop])
                    if dropped and misses[s] < stage.patience:
                        current[s] = [f for f in current[s] if f not in dropped]
                        still_open.append(s)
                if number == len(stages) - 1:
                    finish([s for s in open_splits if s not in still_open])
                open_splits = still_open
        finish(splits)
    out = [(s, i, f) for s in splits for i, f in enumerate(best_set[s])]
    return out


def _cap_per_split(weighted: Weighted, cap: int) -> DataFrame:
    order = HashOrder(weighted.df, weighted.keys, "importance", stratum=weighted.fold)
    if all(n <= cap for n in order.counts.values()):
        return weighted.df
    return weighted.df.where(order.segment(order.cuts({s: [cap] for s in order.counts})) == 0)


# ---------------------------------------------------------------- votes

def selected_frame(df: DataFrame, selected: Sequence[tuple[int, int, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(selected), "split int, position int, feature string")


def majority_vote(selected: DataFrame, n_splits: int, by: Sequence[str] = ()) -> DataFrame:
    """Features chosen in more than half of the splits, in first-seen order.

    Input rows are (split, position, feature); output adds ``votes`` and ``first_seen``.
    """
    counted = selected.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min(F.struct("split", "position")).alias("first_seen"),
    )
    return counted.where(F.col("votes") >= n_splits // 2 + 1)


def vote_order(voted: DataFrame) -> list[str]:
    """The voted names in first-seen order; there are no more of them than columns."""
    return [r["feature"] for r in voted.orderBy("first_seen").collect()]


def selection_frequency(selected: DataFrame) -> DataFrame:
    """How often each feature was selected."""
    return selected.groupBy("feature").agg(F.count(F.lit(1)).alias("times"))


# ---------------------------------------------------------------- sequential selection

def select_sequentially(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    features: Sequence[str],
    direction: str = "forward",
    n_features: int | None = None,
    k: int = 3,
    seed: object = 42,
    metric: str = "auc",
) -> list[tuple[int, str, float]]:
    """Sequential feature selection by the mean AUC, or another metric, of the folds: (step, feature, score).

    Forward adds the best candidate, backward removes the one whose absence scores best,
    until ``n_features`` (half of them by default) are chosen. A step scores all candidates
    in one job; weights are computed once, since they do not depend on the chosen set.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction: {direction!r}")
    target = len(features) // 2 if n_features is None else n_features
    if not 0 < target <= len(features):
        raise ValueError("the number of features to select must lie within the table's")
    with scratch():
        folded = stored_stratified_kfold(df.select(*keys, label, *features), keys, label, k, seed)
        made = weigh(folded, keys, label, "fold", k, features)
        weighted = replace(made, df=store(made.df, "weights").df)
        forward = direction == "forward"
        chosen: list[str] = [] if forward else list(features)
        steps: list[tuple[int, str, float]] = []
        while (len(chosen) < target) if forward else (len(chosen) > target):
            trials = {
                f: [*chosen, f] if forward else [c for c in chosen if c != f]
                for f in features
                if (f in chosen) != forward
            }
            scores = score_variants(weighted, [(f, weighted.total(fs)) for f, fs in trials.items()], metric=metric)
            means = {r["variant"]: r["m"] for r in scores.groupBy("variant").agg(F.avg(metric).alias("m")).collect()}
            # Equal to six digits is equal: the earlier feature wins.
            value = {f: WORST[metric] if means.get(f) is None else means[f] for f in trials}
            best = max(trials, key=lambda f: (round(value[f], 6), -list(features).index(f)))
            chosen = trials[best]
            steps.append((len(steps) + 1, best, means.get(best)))
    return steps


def sequential_result(
    features: Sequence[str], steps: Sequence[tuple[int, str, float]], direction: str = "forward"
) -> list[str]:
    """Names left after the steps, in table order."""
    moved = {f for _, f, _ in steps}
    return [f for f in features if (f in moved) == (direction == "forward")]
