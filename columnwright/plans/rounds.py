"""Augmentation rounds: apply a batch of specs, score, prune, score, keep or revert."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from columnwright.functions.hashing import row_hash
from columnwright.operators import bayes, selection, trees
from columnwright.operators.columns import prune_accept
from columnwright.operators.ledger import PERFECT
from columnwright.operators.ordering import HashOrder, require_unique_keys
from columnwright.operators.selection import STAGES, Stage
from columnwright.operators.splits import stratified_kfold_column, training_folds
from columnwright.plans.manifest import Manifest
from columnwright.plans.specs import Spec, accumulate, apply_specs, spec_at_fault, validate
from columnwright.sources.sinks import LEDGER, append_ledger, append_selected, ledger_row, read_ledger
from columnwright.storage import Stored, delete, scratch, store

FOLD, SPLIT, ORDER = "__fold", "__split", "__order"
N_SPLITS = 3


@dataclass
class Setup:
    """What stays the same over all rounds of a run."""

    keys: list[str]
    label: str
    folds: int = 10
    test_size: float = 0.2
    seed: int = 42
    scorer: str = "nb"
    stages: Sequence[Stage] = STAGES
    time_limit_per_split: float = 3600
    sources: Sequence[str] = ()


@dataclass
class Run:
    """Outcome: ledger rows, the accepted table, and every spec that was ever applied."""

    table: DataFrame
    features: list[str]
    ledger: list[dict] = field(default_factory=list)
    applied: list[list[Spec]] = field(default_factory=list)
    selected: list[tuple[int, int, str]] = field(default_factory=list)
    auc_all_before: float | None = None
    auc_all_after: float | None = None

    def ledger_frame(self) -> DataFrame:
        names = [part.split(" ")[0] for part in LEDGER.split(", ")]
        rows = [tuple(r.get(n) for n in names) for r in self.ledger]
        return self.table.sparkSession.createDataFrame(rows, LEDGER)


def prepare(df: DataFrame, setup: Setup, hashed: str | None = None) -> DataFrame:
    """Mark rows once: scoring fold (NULL on the holdout) and pruning split.

    ``hashed`` names a column that holds the rows' hashes already; it is left out.
    """
    keys, label, seed = setup.keys, setup.label, setup.seed
    order = HashOrder(df, keys, seed, stratum=label, hashed=hashed)
    splits = stratified_kfold_column(df, keys, label, N_SPLITS, seed, order)
    folded, _ = training_folds(
        df, keys, label, setup.folds, setup.test_size, seed, FOLD, keep_holdout=True, order=order
    )
    marked = folded.withColumn(SPLIT, splits)
    return marked if hashed is None else marked.drop(hashed)


def mean_cv_auc(
    table: DataFrame, sets: Sequence[Sequence[str]], setup: Setup
) -> list[float]:
    """Mean AUC over the folds of the training part, for each set of features.

    Naive Bayes weights do not depend on the set, so all sets share one weighing.
    """
    train = table.where(F.col(FOLD).isNotNull())
    features = list(dict.fromkeys(f for fs in sets for f in fs))
    mean = lambda scores: scores.agg(F.avg("auc")).first()[0]
    if setup.scorer == "nb":
        with scratch():
            weighted = bayes.weigh(train, setup.keys, setup.label, FOLD, setup.folds, features)
            scores = selection.score_variants(
                weighted, [(str(i), weighted.total(fs)) for i, fs in enumerate(sets)]
            )
            found = {
                r["variant"]: r["m"]
                for r in scores.groupBy("variant").agg(F.avg("auc").alias("m")).collect()
            }
        return [found.get(str(i)) for i in range(len(sets))]
    if setup.scorer in trees.ESTIMATORS:
        with scratch():
            matrix = trees.feature_matrix(
                train, setup.keys, setup.label, features, FOLD, setup.folds, setup.scorer
            )
            return [mean(trees.fold_scores(matrix, fs, FOLD, setup.folds, setup.seed)) for fs in sets]
    raise ValueError(f"unknown scorer: {setup.scorer!r}")


def augment_round(
    table: DataFrame,
    features: Sequence[str],
    batch: Sequence[Spec],
    setup: Setup,
    number: int,
    best: float,
) -> tuple[dict, Stored | None, list[str], list[tuple[int, int, str]], list[Spec]]:
    """One round on a prepared table.

    Gives the ledger row, the written table with the new columns (None if the batch failed),
    the features left after pruning, the selected features per split, and the applied specs.
    What else the round writes is deleted at its end.
    """
    with scratch():
        return _round(table, features, batch, setup, number, best)


def _round(
    table: DataFrame, features: Sequence[str], batch: Sequence[Spec], setup: Setup, number: int, best: float
) -> tuple[dict, Stored | None, list[str], list[tuple[int, int, str]], list[Spec]]:
    names = [s.get("name") if isinstance(s, Mapping) else None for s in batch]
    row = {"round": number, "suggestions": json.dumps(names, default=str), "score_before": best, "accepted": False}
    try:
        specs, _ = validate(batch, table.columns, setup.label)
        added = [*features, *[s["name"] for s in specs]]
        columns = dict.fromkeys([*setup.keys, setup.label, FOLD, SPLIT, *setup.sources, *added])
        augmented = store(apply_specs(table, specs).select(*columns), "augmented", lasting=True)
    except Exception as error:  # no spec at all, one that cannot be resolved, or that fails on some row
        if not spec_at_fault(error):
            raise
        return {**row, "status": "failed", "selected": []}, None, list(features), [], []
    selected = selection.prune_staged(
        augmented.df, setup.keys, setup.label, added,
        splitter=lambda df: df.withColumn("split", F.col(SPLIT)),
        stages=setup.stages, time_limit_per_split=setup.time_limit_per_split, seed=setup.seed,
        copy=False,
    )
    votes = selection.vote_order(
        selection.majority_vote(selection.selected_frame(table, selected), N_SPLITS)
    )
    smaller = prune_accept(added, votes) and bool(votes)
    left = votes if smaller else added
    scores = mean_cv_auc(augmented.df, [added, left] if smaller else [added], setup)
    row["score_added"], row["score_pruned"] = scores[0], scores[-1]
    row["selected"] = votes
    row["accepted"] = row["score_pruned"] > best
    row["status"] = "kept" if row["accepted"] else "reverted"
    return row, augmented, left, selected, specs


def augment_run(
    df: DataFrame,
    features: Sequence[str],
    batches: Sequence[Sequence[Spec]] | Callable[[Run, int], Sequence[Spec] | None],
    setup: Setup,
    max_rounds: int = 11,
    ledger_path: str | None = None,
    selected_path: str | None = None,
    resume_path: str | None = None,
) -> Run:
    """Repeat rounds over batches of specs.

    ``batches`` is a list, or a function of the run so far that gives the next batch (None
    to stop). A round is kept if its score is strictly above all earlier ones; a failed
    batch counts as a round and changes nothing; a perfect score ends the run. Columns in
    ``setup.sources`` can be used by specs but are not features. The table of a kept round
    is the next one's input as it was written; the one before it and those of other rounds
    are deleted, so plans do not grow over rounds. An error deletes them all.

    With ``resume_path``, a folder that every driver can reach, each finished round is committed
    there, and a call with the same folder, columns and setup goes on after the last one: ledger,
    accepted table, features and specs come from there, and only the round that was open runs
    again. The accepted table outlives an error then. ``ledger_path`` gets every round once;
    ``selected_path`` lacks a round whose driver was lost between its commit and that file. Of the
    round that was open, tables may be left in the shared folder. The specs must be JSON values.
    """
    with scratch():
        run, current = _rounds(df, features, batches, setup, max_rounds, ledger_path, selected_path, resume_path)
        current.keep()
    return run


def _rounds(
    df: DataFrame,
    features: Sequence[str],
    batches: Sequence[Sequence[Spec]] | Callable[[Run, int], Sequence[Spec] | None],
    setup: Setup,
    max_rounds: int,
    ledger_path: str | None,
    selected_path: str | None,
    resume_path: str | None,
) -> tuple[Run, Stored]:
    columns = list(dict.fromkeys([*setup.keys, setup.label, *features, *setup.sources]))
    manifest = Manifest(df.sparkSession, resume_path) if resume_path else None
    work = _work(df.select(*columns), features, setup)
    state = manifest.latest() if manifest else None
    if state is None:
        with scratch():
            # Marks are several passes: they read the input and the hash of its rows as written once.
            hashed = store(df.select(*columns, row_hash(setup.keys, setup.seed).alias(ORDER)), "hashed").df
            require_unique_keys(hashed, setup.keys)
            current = store(prepare(hashed, setup, ORDER), "prepared", lasting=True)
        run = Run(current.df, list(features))
        run.auc_all_before = _all_rows(current.df, run.features, setup)
        best = mean_cv_auc(current.df, [run.features], setup)[0]
        run.ledger.append(
            {"round": 0, "status": "baseline", "suggestions": "[]", "selected": list(features),
             "score_before": best, "score_added": best, "score_pruned": best, "accepted": True}
        )
        if manifest:
            _commit(manifest, run, current, best, work, None)
        if ledger_path:
            append_ledger(ledger_row(df.sparkSession, run.ledger[0]), ledger_path)
    else:
        run, current, best = _resumed(df, state, setup, work)
        if ledger_path:
            _append_missing(df, run, ledger_path)
    for number in range(len(run.ledger), max_rounds + 1):
        if _perfect(run.ledger[-1]):
            break
        if callable(batches):
            batch = batches(run, number)
        else:
            batch = batches[number - 1] if number <= len(batches) else None
        if batch is None:
            break
        row, augmented, left, selected, specs = augment_round(
            run.table, run.features, batch, setup, number, best
        )
        run.ledger.append(row)
        run.applied.append(specs)
        unused = augmented
        if row["accepted"]:
            unused, current = current, augmented
            run.table, run.features = _kept(current.df, left, setup), left
            best, run.selected = row["score_pruned"], selected
        if manifest:
            _commit(manifest, run, current, best, work, unused)
        if unused is not None:
            unused.drop()
        if ledger_path:
            append_ledger(ledger_row(df.sparkSession, row), ledger_path)
        if selected_path and selected:
            append_selected(selection.selected_frame(df, selected), selected_path)
    run.auc_all_after = _all_rows(run.table, run.features, setup)
    return run, current


def _perfect(row: Mapping[str, object]) -> bool:
    """The baseline, round 0, ends nothing."""
    return row["round"] > 0 and row.get("score_pruned") is not None and row["score_pruned"] > PERFECT


def _kept(table: DataFrame, features: Sequence[str], setup: Setup) -> DataFrame:
    return table.select(*dict.fromkeys([*setup.keys, setup.label, FOLD, SPLIT, *setup.sources, *features]))


def _work(df: DataFrame, features: Sequence[str], setup: Setup) -> dict:
    """What must be the same for a run to be gone on with, as JSON gives it back."""
    options = {k: v for k, v in asdict(setup).items() if k != "time_limit_per_split"}
    return json.loads(json.dumps({"columns": df.schema.jsonValue(), "features": list(features), "setup": options}))


def _commit(
    manifest: Manifest, run: Run, current: Stored, best: float, work: dict, unused: Stored | None
) -> None:
    """Commit the last round. From then on the accepted table belongs to the manifest."""
    manifest.commit(run.ledger[-1]["round"], {
        "work": work, "ledger": run.ledger, "applied": run.applied, "selected": run.selected,
        "features": run.features, "best": best, "auc_all_before": run.auc_all_before,
        "table": current.path, "schema": current.df.schema.jsonValue(),
        "unused": unused.path if unused is not None else None,
    })
    current.keep()


def _resumed(df: DataFrame, state: dict, setup: Setup, work: dict) -> tuple[Run, Stored, float]:
    if state["work"] != work:
        raise ValueError("the folder holds a run with other columns, features or setup")
    spark = df.sparkSession

    if state["unused"]:  # the driver may have been lost before it deleted this one
        delete(spark, state["unused"])
    schema = T.StructType.fromJson(state["schema"])
    current = Stored(spark.read.schema(schema).parquet(state["table"]), state["table"])
    run = Run(
        _kept(current.df, state["features"], setup), state["features"], state["ledger"], state["applied"],
        [tuple(s) for s in state["selected"]], state["auc_all_before"],
    )
    return run, current, state["best"]


def _append_missing(df: DataFrame, run: Run, ledger_path: str) -> None:
    """Rounds that were committed but had not reached the ledger file."""
    try:
        there = {r["round"] for r in read_ledger(df.sparkSession, ledger_path).select("round").collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        there = set()
    for row in run.ledger:
        if row["round"] not in there:
            append_ledger(ledger_row(df.sparkSession, row), ledger_path)


def _all_rows(table: DataFrame, features: Sequence[str], setup: Setup) -> float:
    with scratch():
        scores = trees.kfold_auc_all(
            table, setup.keys, setup.label, features, setup.folds, setup.seed, setup.scorer
        )
        return scores.agg(F.avg("auc")).first()[0]


def all_columns(df: DataFrame, run: Run) -> DataFrame:
    """The table with every column ever added, the latest round winning per name."""
    return accumulate(df, run.applied)
