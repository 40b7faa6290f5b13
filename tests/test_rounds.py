import os
import random

import pytest
from pyspark.sql import functions as F

from columnwright.plans import rounds
from columnwright.plans.manifest import Manifest, RoundTaken
from columnwright.sources import sinks
from columnwright.storage import shared_folder, store


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, rng.random(), int((a > 0.5) != (b > 0.5))))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label int")


DIFFERENT = {"name": "different", "op": "expr", "input": [], "args": {"sql": "(a > 0.5) <> (b > 0.5)"}}
HALF = {"name": "half", "op": "expr", "input": [], "args": {"sql": "case when id % 7 = 0 then c else cast(a > 0.5 and b < 0.5 as double) end"}}
BAD = {"name": "bad", "op": "expr", "input": [], "args": {"sql": "1 / cast(id - id as int)"}}


def setup(**options):
    return rounds.Setup(["id"], "label", folds=3, stages=(rounds.Stage(0.5, 1, True),), **options)


def test_a_run_keeps_what_helps(spark, table, tmp_path):
    batches = [[HALF], [BAD], [{"name": "leak", "op": "expr", "input": [], "args": {"sql": "label"}}], [DIFFERENT], [HALF]]
    paths = str(tmp_path / "ledger"), str(tmp_path / "selected")
    run = rounds.augment_run(table, ["a", "b", "c"], batches, setup(sources=["a", "b"]), 11, *paths)
    assert [r["status"] for r in run.ledger] == ["baseline", "kept", "failed", "reverted", "kept"]
    assert run.ledger[-1]["score_pruned"] == 1.0
    assert "different" in run.features and "leak" not in run.table.columns
    assert run.auc_all_after > run.auc_all_before
    assert sinks.read_ledger(spark, paths[0]).count() == 5
    assert {r["split"] for r in sinks.read_selected(spark, paths[1]).collect()} == {0, 1, 2}
    everything = rounds.all_columns(table, run)
    assert {"half", "different", "bad"} & set(everything.columns) == {"half", "different"}
    assert everything.count() == 300
    assert run.ledger_frame().where("accepted").count() == 3


def test_only_the_accepted_table_is_left(spark, table):
    store(spark.range(1))
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "columnwright")
    before = set(os.listdir(folder))
    band = {"name": "band", "op": "pct_rank", "input": ["c"]}
    run = rounds.augment_run(table, ["a", "c"], [[HALF, band], [BAD], [DIFFERENT]], setup(sources=["b"]))
    assert [r["status"] for r in run.ledger][-1] == "kept"
    assert len(set(os.listdir(folder)) - before) == 1
    assert "Join" not in run.table._jdf.queryExecution().optimizedPlan().toString()
    assert run.table.count() == 300
    kept = set(os.listdir(folder))
    with pytest.raises(ZeroDivisionError):
        rounds.augment_run(table, ["c"], lambda run, number: [1 // 0], setup())
    assert set(os.listdir(folder)) == kept


def test_batches_may_depend_on_the_run(table):
    seen = []

    def propose(run, number):
        seen.append((number, list(run.features)))
        return [HALF] if number == 1 else None

    run = rounds.augment_run(table, ["a", "c"], propose, setup(sources=["b"]))
    assert [n for n, _ in seen] == [1, 2] and len(run.ledger) == 2


def test_rounds_are_limited(table):
    run = rounds.augment_run(table, ["c"], [[BAD], [BAD], [BAD]], setup(), max_rounds=2)
    assert [r["round"] for r in run.ledger] == [0, 1, 2]


def test_keys_must_be_unique(table):
    with pytest.raises(ValueError):
        rounds.augment_run(table.union(table), ["c"], [], setup())
    with pytest.raises(ValueError):
        rounds.augment_run(table, ["c"], [], setup(scorer="other"))


def test_scorer_can_be_chosen(table):
    run = rounds.augment_run(table, ["a", "b"], [], setup(scorer="lr"))
    assert 0 < run.ledger[0]["score_pruned"] < 1


class Lost(Exception):
    """Stands for the end of a driver."""


def tables_left(before, folder):
    return {p for p in set(os.listdir(folder)) - before}


def test_a_lost_run_is_gone_on_with(spark, table, tmp_path, monkeypatch):
    store(spark.range(1))
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "columnwright")
    batches = [[HALF], [BAD], [DIFFERENT], [HALF]]
    options = setup(sources=["a", "b"])
    whole = rounds.augment_run(table, ["a", "c"], batches, options)
    state, ledger = str(tmp_path / "state"), str(tmp_path / "ledger")
    before = set(os.listdir(folder))

    def until_third(run, number):
        if number == 3:
            raise Lost
        return batches[number - 1]

    with pytest.raises(Lost):
        rounds.augment_run(table, ["a", "c"], until_third, options, ledger_path=ledger, resume_path=state)
    assert Manifest(spark, state).rounds() == [0, 1, 2]
    assert len(tables_left(before, folder)) == 1
    ran, real = [], rounds.augment_round
    monkeypatch.setattr(rounds, "augment_round", lambda *a: ran.append(a[4]) or real(*a))
    run = rounds.augment_run(table, ["a", "c"], batches, options, ledger_path=ledger, resume_path=state)
    assert ran == list(range(3, len(whole.ledger)))
    assert run.ledger == whole.ledger and run.features == whole.features
    assert run.applied == whole.applied and run.selected == whole.selected
    assert (run.auc_all_before, run.auc_all_after) == (whole.auc_all_before, whole.auc_all_after)
    order = lambda t: sorted(map(tuple, t.collect()))
    assert run.table.columns == whole.table.columns and order(run.table) == order(whole.table)
    assert [r["round"] for r in sinks.read_ledger(spark, ledger).orderBy("round").collect()] == list(range(len(run.ledger)))
    assert len(tables_left(before, folder)) == 1
    # A finished run is not repeated.
    again = rounds.augment_run(table, ["a", "c"], batches, options, ledger_path=ledger, resume_path=state)
    assert ran == list(range(3, len(whole.ledger))) and again.ledger == run.ledger
    with pytest.raises(ValueError):
        rounds.augment_run(table, ["a", "c"], batches, setup(sources=["b"]), resume_path=state)


def test_rounds_committed_before_the_ledger_file_are_added_to_it(spark, table, tmp_path, monkeypatch):
    state, ledger = str(tmp_path / "state"), str(tmp_path / "ledger")

    def lost(*args):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(rounds, "append_ledger", lost)
        with pytest.raises(Lost):
            rounds.augment_run(table, ["c"], [[BAD]], setup(), ledger_path=ledger, resume_path=state)
    rounds.augment_run(table, ["c"], [[BAD]], setup(), ledger_path=ledger, resume_path=state)
    assert sorted(r["round"] for r in sinks.read_ledger(spark, ledger).collect()) == [0, 1]


def test_a_round_gets_one_state(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "state"))
    assert manifest.latest() is None
    manifest.commit(0, {"a": [1, None, "\u00e9\n"]})
    manifest.commit(1, {"b": 2.5})
    with pytest.raises(RoundTaken):
        manifest.commit(1, {"b": 3})
    assert manifest.latest() == {"b": 2.5} and manifest.rounds() == [0, 1]
    assert not [n for n in os.listdir(tmp_path / "state") if n.startswith("_open")]
