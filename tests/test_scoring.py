import hashlib
import math
import os
import re
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from columnwright.operators import bayes, ranks, selection, splits, trees
from columnwright.operators.selection import SAMPLED_STAGES, Stage
from columnwright.sources import sinks


def table(spark, n=400, seed=1):
    """A label, a number that follows it, a category that partly does, and noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i, y, y * 2 + rng.gauss(0, 1), rng.choice("ab" if y else "bc"), rng.random(), f"u{i}"))
    return spark.createDataFrame(rows, "id int, y int, x double, c string, noise double, unique string")


def brute_weights(rows, fold_of, value_of, k, n_values):
    """Weights of one feature by (fold, value), straight from the definition."""
    out = {}
    for f in range(k):
        train = [r for r in rows if fold_of[r["id"]] != f]
        pos = Counter(value_of(r) for r in train if r["y"] == 1)
        neg = Counter(value_of(r) for r in train if r["y"] == 0)
        p, n = sum(pos.values()), sum(neg.values())
        for v in {value_of(r) for r in rows}:
            if pos[v] + neg[v]:
                odds = math.log((pos[v] + 1) / (p + n_values)) - math.log((neg[v] + 1) / (n + n_values))
                out[f, v] = round(odds * bayes.UNIT)
            else:
                out[f, v] = 0
    return out


@pytest.mark.parametrize("small", [bayes.SMALL_VOCABULARY, 0])
def test_weights_follow_their_definition(spark, monkeypatch, small):
    monkeypatch.setattr(bayes, "SMALL_VOCABULARY", small)
    df = splits.kfold(table(spark), ["id"], 4)
    rows = df.collect()
    fold_of = {r["id"]: r["fold"] for r in rows}
    want = brute_weights(rows, fold_of, lambda r: r["c"], 4, 3)
    weighted = bayes.weigh(df, ["id"], "y", "fold", 4, ["c", "unique"])
    got = {r["id"]: r for r in weighted.df.collect()}
    assert len(got) == 400
    for r in rows:
        assert abs(got[r["id"]][weighted.columns["c"]] - want[fold_of[r["id"]], r["c"]]) <= 1
        # A value seen in one row only is unknown to the model that scores the row.
        assert got[r["id"]][weighted.columns["unique"]] == 0


def test_missing_is_a_value_unless_imputed(spark):
    df = table(spark).withColumn("x", F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    df = splits.kfold(df, ["id"], 3)
    for impute in (True, False):
        w = bayes.weigh(df, ["id"], "y", "fold", 3, ["x"], impute=impute)
        gaps = w.df.where("id % 4 = 0").select(*w.columns.values()).distinct().count()
        assert gaps <= 3
        assert w.df.count() == 400


def test_scores(spark):
    df = table(spark)
    scores = [r["auc"] for r in bayes.cv_auc(df, ["id"], "y", ["x", "c", "noise"], 5).collect()]
    assert len(scores) == 5 and min(scores) > 0.8
    assert bayes.holdout_auc(df, ["id"], "y", ["x", "c"]).first()["auc"] > 0.8
    nothing = [r["auc"] for r in bayes.kfold_auc_all(df, ["id"], "y", ["unique"], 4).collect()]
    assert nothing == [0.5] * 4


def test_same_scores_for_any_partitioning(spark):
    df = table(spark)
    runs = [bayes.cv_auc(df.repartition(n), ["id"], "y", ["x", "c"], 3).collect() for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]


def test_scorers(spark):
    df = table(spark, 200)
    for scorer in ("nb", "lr", "gbt"):
        scores = trees.cv_auc(df, ["id"], "y", ["x", "c"], 2, scorer=scorer).collect()
        assert len(scores) == 2 and all(r["auc"] > 0.75 for r in scores)
    with pytest.raises(ValueError):
        trees.cv_auc(df, ["id"], "y", ["x"], 2, scorer="other")


def brute_training_values(rows, feature, k, top, min_rows):
    out = {}
    for i in range(k):
        counts = Counter(hashlib.md5(r[feature].encode()).hexdigest() for r in rows if r["fold"] != i and r[feature] is not None)
        ranked = sorted((-n, v) for v, n in counts.items() if n >= min_rows)[:top]
        out.update({(feature, i, v): (-n, code) for code, (n, v) in enumerate(ranked, 1)})
    return out


@pytest.mark.parametrize("top", [2, 255])
def test_values_that_trees_know_come_from_training_rows(spark, top):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice(["a", "b", "c", "d", None]), f"{rng.randrange(40)}") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, fold int, c string, d string")
    found = trees.training_values(df, ["c", "d"], "fold", 3, top).collect()
    got = {(r["feature"], r["fold"], r["value"]): (r["rows"], r["code"]) for r in found}
    local = df.collect()
    assert got == {**brute_training_values(local, "c", 3, top, 2), **brute_training_values(local, "d", 3, top, 2)}


def parity_table(spark, n=2000, values=150):
    """The label follows whether a category's number is even: its order among values says nothing."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        v = rng.randrange(values)
        rows.append((i, int((v % 2 == 0) != (rng.random() < 0.05)), f"{v:04d}"))
    return spark.createDataFrame(rows, "id int, y int, c string")


def test_order_of_categories_does_not_mislead(spark):
    df = parity_table(spark)
    for scorer in ("gbt", "lr"):
        scores = trees.kfold_auc_all(df, ["id"], "y", ["c"], 2, scorer=scorer).collect()
        assert all(r["auc"] > 0.9 for r in scores), (scorer, scores)
    # What the codes give if they are read as numbers.
    read = ranks.category_codes(df, "c", "n").select("id", "y", "n")
    assert all(r["auc"] < 0.8 for r in trees.kfold_auc_all(read, ["id"], "y", ["n"], 2, scorer="gbt").collect())


def test_unknown_rare_and_missing_categories(spark):
    """A name without training rows, one per row, all missing, quoted column names, tiny folds."""
    rows = [(i, i % 2, None, f"u{i}", ["x", None][i % 2], i // 2 % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, y int, empty string, own string, `a b` string, part int")
    for scorer in ("gbt", "lr"):
        scores = trees.scored_folds(df, ["id"], "y", ["empty", "own", "a b"], "part", 2, scorer).collect()
        assert [r["fold"] for r in scores] == [0, 1] and all(r["auc"] == 1.0 for r in scores)
    alone = trees.scored_folds(df, ["id"], "y", ["own"], "part", 2, "lr").collect()
    assert all(abs(r["auc"] - 0.5) < 1e-9 for r in alone)


def test_scorers_on_all_rows_and_on_the_holdout(spark):
    df = table(spark, 200)
    for scorer in ("nb", "lr"):
        scores = trees.kfold_auc_all(df, ["id"], "y", ["x", "c"], 2, scorer=scorer).collect()
        assert [r["fold"] for r in scores] == [0, 1] and all(r["auc"] > 0.75 for r in scores)
        assert trees.holdout_auc(df, ["id"], "y", ["x", "c"], scorer=scorer).first()["auc"] > 0.7
    for function in (trees.kfold_auc_all, trees.holdout_auc):
        with pytest.raises(ValueError):
            function(df, ["id"], "y", ["x"], scorer="other")


def test_columns_may_have_any_name(spark):
    df = table(spark).select("id", F.col("y").alias("score"), F.col("x").alias("v0"), F.col("c").alias("y"))
    assert bayes.cv_auc(df, ["id"], "score", ["v0", "y"], 3).count() == 3


# ---------------------------------------------------------------- selection


def test_permutation_is_one_ring_per_fold(spark):
    df = splits.kfold(table(spark), ["id"], 3)
    weighted = bayes.weigh(df, ["id"], "y", "fold", 3, ["x", "c"])
    seen = []
    for per_range in (selection.RANGE_ROWS, 40, 7):
        swapped, names = selection.permute(weighted, per_range)
        seen.append(sorted(map(tuple, swapped.df.collect())))
        for f, column in weighted.columns.items():
            sums = swapped.df.groupBy("fold").agg(F.sum(column).alias("a"), F.sum(names[f]).alias("b")).collect()
            assert all(r["a"] == r["b"] for r in sums)
            assert swapped.df.where(F.col(column) != F.col(names[f])).count() > 50
    assert seen[0] == seen[1] == seen[2]


def test_the_ring_is_cut_without_a_sample_and_its_hash_may_be_stored(spark):
    """Ranges follow from the hash: no pass over the table samples it, none works a stored hash out again."""
    df = table(spark)
    plain = bayes.weigh(splits.stratified_kfold(df, ["id"], "y", 3), ["id"], "y", "fold", 3, ["x", "c"])
    stored = splits.stored_stratified_kfold(
        df, ["id"], "y", 3, columns=["y", "x", "c", selection.ring_hash(["id"]).alias("ring")])
    weighted = bayes.weigh(stored, ["ring"], "y", "fold", 3, ["x", "c"])
    found = []
    for made, hashed in ((plain, None), (weighted, "ring")):
        for per_range in (selection.RANGE_ROWS, 11):
            swapped, names = selection.permute(made, per_range, hashed=hashed)
            wanted = ["y", "fold", *made.columns.values(), *names.values()]
            found.append(sorted(map(tuple, swapped.df.select(*wanted).collect())))
    plan = swapped.df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "RepartitionByExpression [fold" in plan and "ASC" not in plan.split("RepartitionByExpression")[1].split("\n")[0]
    assert found[0] == found[1] == found[2] == found[3]


def test_scores_of_many_sets_are_compiled(spark, capsys):
    """The JVM does not compile a method of more than 8,000 bytes: rounds then take ten times as long."""
    names = [f"f{i}" for i in range(12)]
    df = spark.range(90).selectExpr("id", "cast(id % 2 as int) as y", *[f"cast(hash(id, {i}) as double) as {f}" for i, f in enumerate(names)])
    weighted = bayes.weigh(splits.stratified_kfold(df, ["id"], "y", 3), ["id"], "y", "fold", 3, names)
    swapped, permuted = selection.permute(weighted)
    stored = swapped.df.localCheckpoint()
    active = {0: names[:9], 1: names[2:], 2: names}
    rows, variants = selection.importance_variants(swapped, permuted, active, names[-3:], stored)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        selection.score_variants(swapped, variants, rows).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
    got = {(r["fold"], r["variant"]) for r in selection.score_variants(swapped, variants, rows).collect()}
    extra = [selection.BASE, selection.PLAIN]
    assert got == {(s, f) for s, fs in active.items() for f in [*fs, *extra]}


def test_importance_ranks_the_signal_first(spark):
    df = splits.stratified_kfold(table(spark), ["id"], "y", 3)
    found = selection.permutation_importance(bayes.weigh(df, ["id"], "y", "fold", 3, ["x", "c", "noise"]))
    means = {r["feature"]: r["m"] for r in found.groupBy("feature").agg(F.avg("importance").alias("m")).collect()}
    assert means["x"] > means["noise"] and means["c"] > means["noise"]


def test_useless_features(spark):
    df = table(spark).withColumns({
        "twin": F.col("c"), "one": F.lit(1), "none": F.lit(None).cast("double"),
        "almost": F.when(F.col("id") == 7, F.lit("q")).otherwise(F.col("c")),
        "gap": F.when(F.col("id") > 5, F.lit(2.0)),
    })
    df = splits.stratified_kfold(df, ["id"], "y", 3, name="split")
    names = ["x", "c", "twin", "one", "none", "almost", "gap"]
    assert selection.useless_features(df, ["id"], names)[None] == ["one", "none", "twin"]
    per_split = selection.useless_features(df, ["id"], names, "split")
    with_row = df.where("id = 7").first()["split"]
    for s in range(3):
        assert per_split[s][:3] == ["one", "none", "twin"]
        # Without row 7, the other column is a twin as well.
        assert ("almost" in per_split[s]) == (s == with_row)


@pytest.mark.parametrize("stages", [selection.STAGES, SAMPLED_STAGES, (Stage(0.5, 1, True, 30),)])
def test_pruning_keeps_the_signal(spark, stages):
    df = table(spark)
    parts = {}
    out = selection.prune_staged(
        df, ["id"], "y", ["noise", "x", "c", "unique"], stages=stages, on_split=parts.__setitem__)
    assert {s for s, _, _ in out} == {0, 1, 2}
    for s in range(3):
        chosen = [f for t, _, f in out if t == s]
        assert "x" in chosen and [p for t, p, _ in out if t == s] == list(range(len(chosen)))
    assert parts == {s: [f for t, _, f in out if t == s] for s in range(3)}


def test_a_split_is_written_while_others_go_on(spark, tmp_path, monkeypatch):
    """Split 0 has one feature left early; its folder is there when the others are scored again."""
    path = str(tmp_path / "selected")
    seen, real = [], selection.score_variants

    def watched(weighted, variants, rows=None, metric="auc"):
        seen.append(sorted(r["split"] for r in sinks.read_selected_splits(spark, path).select("split").distinct().collect())
                    if os.path.isdir(path) else [])
        found = real(weighted, variants, rows, metric)
        # Split 0 gets worse with every round, so that it runs out of patience first.
        worse = F.when(F.col(weighted.fold) == 0, F.col("auc") - len(seen)).otherwise(F.lit(1.0))
        return found.withColumn("auc", worse)

    monkeypatch.setattr(selection, "score_variants", watched)
    write = lambda split, features: sinks.write_selected_split(spark, split, features, path)
    stages = (Stage(0.2, 2),)
    out = selection.prune_staged(table(spark), ["id"], "y", ["noise", "x", "c", "unique"], stages=stages, on_split=write)
    assert [0] in seen
    got = sorted(tuple(r) for r in sinks.read_selected_splits(spark, path).collect())
    assert got == sorted(out)
    write(0, ["x"])  # once more takes the place of the first time
    again = sinks.read_selected_splits(spark, path)
    assert [r["feature"] for r in again.where("split = 0").collect()] == ["x"]
    assert again.where("split = 1").count() == sum(t == 1 for t, _, _ in out)


def endless(spark):
    return spark.range(10**15).select(F.sum(F.col("id") % 7)).collect()


def test_jobs_are_cancelled_at_the_deadline(spark):
    began = time.monotonic()
    with pytest.raises(selection.TimeUp):
        with selection.time_limit(spark, began + 1):
            endless(spark)
    assert time.monotonic() - began < 30
    with selection.time_limit(spark, time.monotonic() + 100):
        assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError):
        with selection.time_limit(spark, time.monotonic() + 100):
            1 / 0
    with pytest.raises(selection.TimeUp):
        with selection.time_limit(spark, time.monotonic() - 1):
            raise AssertionError("must not run")


def test_a_slow_round_ends_in_time_with_the_best_set(spark, monkeypatch):
    def slow(weighted, variants, rows=None, metric="auc"):
        made = spark.range(10**15).where("id % 7 > 8")
        return made.select(F.lit(0).alias("split"), F.lit("x").alias("variant"), F.lit(1.0).alias("auc"))

    monkeypatch.setattr(selection, "score_variants", slow)
    parts, began = {}, time.monotonic()
    out = selection.prune_staged(
        table(spark), ["id"], "y", ["noise", "x"], time_limit_per_split=1, on_split=parts.__setitem__)
    assert time.monotonic() - began < 90
    assert parts == dict.fromkeys(range(3), ["noise", "x"]) and len(out) == 6


@pytest.mark.parametrize("metric", ["accuracy", "neg_log_loss"])
def test_pruning_by_another_metric(spark, metric):
    out = selection.prune_staged(table(spark), ["id"], "y", ["noise", "x", "c", "unique"], metric=metric)
    for s in range(3):
        assert "x" in [f for t, _, f in out if t == s]
    with pytest.raises(KeyError):
        selection.prune_staged(table(spark), ["id"], "y", ["x"], metric="luck")


def test_no_time_keeps_all_but_useless(spark):
    df = table(spark).withColumn("one", F.lit(1))
    out = selection.prune_staged(df, ["id"], "y", ["x", "one"], time_limit_per_split=0)
    assert [f for _, _, f in out] == ["x"] * 3


def pruning_fixture(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        y = int(rng.random() < 0.9)
        good = y if rng.random() >= 0.1 else 1 - y
        rows.append((i, int(rng.random() < 0.5), good, y))
    return spark.createDataFrame(rows, "id int, feature_stupid int, feature_good int, label int")


def test_good_feature_survives_in_nearly_all_seeds(spark):
    kept = Counter()
    for seed in range(10):
        df = pruning_fixture(spark, seed)
        out = selection.prune_staged(df, ["id"], "label", ["feature_stupid", "feature_good"])
        voted = selection.majority_vote(selection.selected_frame(df, out), 3)
        kept.update(selection.vote_order(voted))
    assert kept["feature_good"] >= 9
    assert kept["feature_stupid"] < kept["feature_good"]


def test_majority_vote(spark):
    rows = [(0, 0, "b"), (0, 1, "a"), (1, 0, "a"), (1, 1, "c"), (2, 0, "b"), (2, 1, "d")]
    df = selection.selected_frame(spark.range(1), rows)
    assert selection.vote_order(selection.majority_vote(df, 3)) == ["b", "a"]
    assert selection.vote_order(selection.majority_vote(df, 4)) == []
    assert {r["feature"]: r["times"] for r in selection.selection_frequency(df).collect()} == {
        "a": 2, "b": 2, "c": 1, "d": 1}


def test_prune_round_and_noise(spark):
    rows = [(0, "a", 0.1), (0, "b", 0.3), (0, "c", 0.1), (0, "__noise_0", 0.2), (1, "a", 0.0), (1, "__noise_0", -0.1)]
    df = spark.createDataFrame(rows, "fold int, feature string, importance double")
    left = {(r["fold"], r["feature"]) for r in selection.prune_round(df, 0.3).collect()}
    assert left == {(0, "__noise_0"), (0, "b"), (1, "a")}
    keep = {(r["fold"], r["feature"]): r["keep"] for r in selection.noise_threshold(df, ["__noise_0"]).collect()}
    assert keep == {(0, "a"): False, (0, "b"): True, (0, "c"): False, (1, "a"): True}


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_sequential_selection(spark, direction):
    names = ["noise", "x", "unique", "c"]
    steps = selection.select_sequentially(table(spark), ["id"], "y", names, direction)
    assert set(selection.sequential_result(names, steps, direction)) == {"x", "c"}
    assert [s for s, _, _ in steps] == [1, 2]


def test_sequential_selection_needs_a_direction(spark):
    with pytest.raises(ValueError):
        selection.select_sequentially(spark.range(1), ["id"], "y", ["a"], "sideways")
