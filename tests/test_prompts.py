import pytest
from pyspark.sql import functions as F

from columnwright.operators import ledger, prompts as ops
from columnwright.plans import experiment


@pytest.fixture(scope="module")
def task(spark):
    rows = [(i, f"text {i % 9}", "Yes" if i % 3 else "No") for i in range(30)]
    return ops.text_task(spark.createDataFrame(rows, "id int, body string, label string"), ["id"], "body", "label")


def predict(pairs):
    """Right for the first prompt, always ``yes`` for the others."""
    guess = F.when(F.col("prompt") == "a", F.col("y")).otherwise(F.lit("yes"))
    return pairs.withColumn("prediction", guess).withColumn("sequence", F.concat(F.lit("says "), guess))


def test_every_prompt_meets_every_example(task):
    pairs = ops.pairs_cross(task, ["a", "b"])
    assert pairs.count() == 60 and pairs.select("prompt", "id").distinct().count() == 60
    assert ops.pairs_cross(task, []).count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_only_unknown_pairs_are_predicted(task):
    asked = []

    def counting(pairs):
        asked.append(pairs.count())
        return predict(pairs)

    collected, cache = experiment.evaluate(task, ["id"], ["a"], counting)
    assert asked == [9] and cache.count() == 9 and collected.count() == 30
    again, cache = experiment.evaluate(task, ["id"], ["a", "b"], counting, cache)
    assert asked == [9, 9] and cache.count() == 18
    assert again.where("score IS NULL").count() == 0
    none, cache = experiment.evaluate(task, ["id"], ["a", "c"], counting, cache, strategy="evaluated")
    assert asked == [9, 9, 0] and none.where("score IS NULL").count() == 30
    assert {r["prompt"]: r["score"] for r in ops.prompt_scores(none).collect()} == {"a": 1.0, "c": None}


def test_strategies_look_at_their_rows(task):
    for strategy, size in (("full", 30), ("subsample", 10), ("random_block", 10), ("sequential_block", 10)):
        collected, _ = experiment.evaluate(task, ["id"], ["a"], predict, strategy=strategy, n=10)
        assert collected.count() == size


def test_leaderboard(task):
    board = experiment.run_evaluation(task, ["id"], ["b", "a", "c"], predict)
    rows = [(r["prompt"], round(r["score"], 6)) for r in board.collect()]
    assert rows == [("a", 1.0), ("b", 0.666667), ("c", 0.666667)]


def test_experiment_scores_the_rows_not_used_for_choosing(task):
    sizes = []

    def choose(train):
        sizes.append(train.count())
        return ["a"]

    board = experiment.run_experiment(task, ["id"], choose, predict)
    assert sizes == [24] and board.first()["score"] == 1.0
    board = experiment.run_experiment(task, ["id"], ["b"], predict, n_exemplars=2)
    text = board.first()["prompt"]
    assert text.count("Input: ") == 2 and text.endswith("\n\nb")


def test_exemplars(task):
    out = {(r["prompt"], r["seed"]): r["text"] for r in ops.exemplars_random(task, ["id"], ["a", "b"], 3, [1, 2]).collect()}
    assert len(out) == 4 and len(set(out.values())) == 4
    assert all(t.count("Output: ") == 3 for t in out.values())
    plan = ops.exemplars_random(task, ["id"], ["a"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_best_exemplars(spark):
    candidates = spark.createDataFrame(
        [("a", 1, "t1"), ("a", 2, "t2"), ("a", 3, "t3"), ("b", 1, "t4")], "prompt string, seed int, text string")
    scores = spark.createDataFrame([("t1", 0.5), ("t2", 0.9), ("t3", 0.9), ("t4", None)], "prompt string, score double")
    best = {r["prompt"]: r["text"] for r in ops.exemplars_search(candidates, scores).collect()}
    assert best == {"a": "t2", "b": "t4"}


def test_rungs_grow_to_the_whole_task():
    assert experiment.rung_sizes(1000, 100, 2) == [100, 200, 400, 800, 1000]
    assert experiment.rung_sizes(30, 100, 2) == [30] and experiment.rung_sizes(100, 100, 3) == [100]
    assert experiment.rung_sizes(0, 10, 2) == [0]


def test_race_of_exemplars(spark):
    """Survivors and the winner by a plain loop; later rungs ask for new pairs only."""
    rows = [(i, f"x{i % 90}", "Yes" if i % 3 else "No") for i in range(200)]
    task = ops.text_task(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b")
    asked = []

    def predict(pairs):
        asked.append({(r["prompt"], r["x"], r["y"]) for r in pairs.collect()})
        good = F.pmod(F.xxhash64("prompt", "x"), F.lit(10)) < F.pmod(F.xxhash64("prompt"), F.lit(8)) + 1
        return pairs.withColumn("prediction", F.when(good, F.col("y"))).withColumn("sequence", F.lit("s"))

    race = experiment.race_exemplars(task, ["id"], ["a", "b", "a"], predict, 2, [3, 1, 2, 4, 5], first_rows=25)
    rungs = race.rungs.collect()
    assert {(r["rung"], r["rows"]) for r in rungs} == {(0, 25), (1, 50), (2, 100), (3, 200)}
    for prompt in ("a", "b"):
        own = {k: {r["seed"]: r["score"] for r in rungs if r["rung"] == k and r["prompt"] == prompt} for k in range(4)}
        assert set(own[0]) == {1, 2, 3, 4, 5}
        for k, n in ((0, 3), (1, 2), (2, 1)):
            stay = sorted(own[k], key=lambda s: (-own[k][s], s))[:n]
            assert set(own[k + 1]) == set(stay)
        winner = next(r for r in race.best.collect() if r["prompt"] == prompt)
        assert winner["seed"] in own[3] and winner["score"] == own[3][winner["seed"]]
        assert winner["text"].count("Input: ") == 2 and winner["text"].endswith(prompt)
    assert not any(a & b for i, a in enumerate(asked) for b in asked[:i])
    again = experiment.race_exemplars(task, ["id"], ["a", "b"], predict, 2, [1, 2, 3, 4, 5], race.cache, 25)
    assert sum(map(len, asked[4:])) == 0 and sorted(again.best.collect()) == sorted(race.best.collect())


def test_race_without_rows_or_candidates(spark):
    task = ops.text_task(spark.createDataFrame([], "id int, a string, b string"), ["id"], "a", "b")
    assert experiment.race_exemplars(task, ["id"], ["a"], predict).best.count() == 0
    assert experiment.race_exemplars(task, ["id"], [], predict).best.count() == 0
    with pytest.raises(ValueError):
        experiment.race_exemplars(task, ["id"], ["a"], predict, eta=1)


def test_custom_match(task):
    match = lambda y, p: F.when(p == "yes", 0.25).otherwise(0.75)
    collected, _ = experiment.evaluate(task, ["id"], ["b"], predict, match=match)
    assert {r["score"] for r in collected.collect()} == {0.25}


# ---------------------------------------------------------------- ledgers


@pytest.fixture(scope="module")
def rounds(spark):
    rows = [(0, 0.5, "baseline"), (1, 0.5, "scored"), (2, 0.7, "scored"), (3, None, "failed"), (4, 0.6, "scored"),
            (5, 0.99999995, "scored"), (6, 1.0, "scored")]
    return spark.createDataFrame(rows, "round int, score double, status string")


def test_only_a_strictly_better_round_is_accepted(rounds):
    out = {r["round"]: r["accepted"] for r in ledger.accept_rounds(rounds, status="status").collect()}
    assert out == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_a_perfect_round_is_the_last(rounds):
    assert sorted(r["round"] for r in ledger.stop_rounds(rounds).collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r["round"] for r in ledger.history_tail(rounds).collect()) == [4, 5, 6]


def test_history_text(spark):
    responses = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "round int, response string")
    chosen = spark.createDataFrame([(2, "[b]"), (1, "[a]")], "round int, selected string")
    text = ledger.render_history(ledger.history_zip(responses, chosen)).first()["history"]
    assert text == ("Trial 1:\nPrompt: r1\nSelected Features: [a]\n\n"
                    "Trial 2:\nPrompt: r2\nSelected Features: [b]\n")
    assert ledger.render_history(ledger.history_zip(responses, chosen.limit(0))).first()["history"] == "None"


def test_round_comparison(spark):
    rows = [("before", 0.5), ("before", 0.7), ("added", 0.8), ("pruned", 0.9)]
    out = ledger.compare_scores(spark.createDataFrame(rows, "step string, score double")).first()
    assert tuple(round(v, 6) for v in out) == (0.6, 0.8, 0.9)
