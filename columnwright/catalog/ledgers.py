"""Run ledgers and votes, on ledgers that Spark derives from the orders."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from columnwright.catalog.frames import table
from columnwright.catalog.registry import query
from columnwright.operators import columns as col_ops, ledger, metrics, selection

RUN = ["run"]
ROUND = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1"
LEDGER_SQL = f"""
    SELECT o_orderpriority AS run, CAST({ROUND} AS INTEGER) AS round,
           least(max(o_totalprice) / 499000.0, 1.0) AS score, max(o_custkey) AS customer,
           CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'scored' END AS status
    FROM orders GROUP BY ALL"""


def ledgers(spark, sf):
    """One run per order priority, one round per month."""
    rounds = F.expr(ROUND).cast("int")
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("run"), rounds.alias("round")
    ).agg(
        F.least(F.max("o_totalprice") / 499000.0, F.lit(1.0)).alias("score"),
        F.max("o_custkey").alias("customer"),
        F.when(F.count(F.lit(1)) % 7 == 0, "failed").otherwise("scored").alias("status"),
    )


@query("ledger_accept", f"""
    SELECT run, round, status, coalesce(v > max(v) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS accepted
    FROM (SELECT *, CASE WHEN status <> 'failed' THEN score END AS v FROM ({LEDGER_SQL}))""")
def ledger_accept(spark, sf):
    found = ledger.accept_rounds(ledgers(spark, sf), by=RUN, status="status")
    return found.select("run", "round", "status", "accepted")


@query("ledger_stop", f"""
    WITH l AS ({LEDGER_SQL}), s AS (SELECT run, min(round) AS stop FROM l WHERE score > 0.9999999 AND round > 0 GROUP BY 1)
    SELECT l.run, l.round, round(l.score, 6) AS score FROM l LEFT JOIN s USING (run) WHERE stop IS NULL OR round <= stop""")
def ledger_stop(spark, sf):
    return ledger.stop_rounds(ledgers(spark, sf), by=RUN).select("run", "round", F.round("score", 6).alias("score"))


@query("history_tail", f"""
    SELECT run, round, customer FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round DESC) AS r FROM ({LEDGER_SQL}))
    WHERE r <= 3""")
def history_tail(spark, sf):
    return ledger.history_tail(ledgers(spark, sf), 3, RUN).select("run", "round", "customer")


ZIPPED_SQL = f"""
    SELECT a.run, a.round, 'customer ' || a.customer AS response, b.selected
    FROM ({LEDGER_SQL}) a JOIN (
        SELECT o_orderpriority AS run, CAST({ROUND} AS INTEGER) AS round, 'order ' || min(o_orderkey) AS selected
        FROM orders GROUP BY ALL HAVING max(o_totalprice) > 450000) b ON a.run = b.run AND a.round = b.round"""


def zipped(spark, sf):
    responses = ledgers(spark, sf).select(
        "run", "round", F.concat(F.lit("customer "), F.col("customer").cast("string")).alias("response")
    )
    chosen = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("run"), F.expr(ROUND).cast("int").alias("round")
    ).agg(
        F.concat(F.lit("order "), F.min("o_orderkey").cast("string")).alias("selected"),
        F.max("o_totalprice").alias("top"),
    ).where("top > 450000")
    return ledger.history_zip(responses, chosen, RUN).select("run", "round", "response", "selected")


@query("history_zip", ZIPPED_SQL)
def history_zip(spark, sf):
    return zipped(spark, sf)


@query("render_history", f"""
    SELECT run, string_agg('Trial ' || i || ':' || chr(10) || 'Prompt: ' || response || chr(10) || 'Selected Features: ' || selected || chr(10),
                           chr(10) ORDER BY i) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS i FROM ({ZIPPED_SQL})) GROUP BY run""")
def render_history(spark, sf):
    return ledger.render_history(zipped(spark, sf), RUN)


@query("fold_score_mean", f"SELECT run, round(avg(score), 6) AS score FROM ({LEDGER_SQL}) GROUP BY 1")
def fold_score_mean(spark, sf):
    means = metrics.mean_score(ledgers(spark, sf), "score", RUN)
    return means.select("run", F.round("score", 6).alias("score"))


# ------------------------------------------------------------- votes

SELECTED_SQL = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS run, CAST(quarter(o_orderdate) - 1 AS INTEGER) AS split,
           CAST(row_number() OVER (PARTITION BY year(o_orderdate), quarter(o_orderdate) ORDER BY count(*) DESC, o_orderpriority) - 1 AS INTEGER) AS position,
           o_orderpriority AS feature
    FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate), o_orderpriority
    QUALIFY position < 3"""


def selected(spark, sf):
    """The three most frequent priorities of each quarter: runs are years, splits quarters."""
    counted = table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("run"), (F.quarter("o_orderdate") - 1).alias("split"),
        F.col("o_orderpriority").alias("feature"),
    ).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("run", "split").orderBy(F.desc("n"), "feature")
    ranked = counted.withColumn("position", F.row_number().over(order) - 1)
    return ranked.where("position < 3").select("run", "split", "position", "feature")


VOTED_SQL = f"""
    SELECT run, feature, count(*) AS votes, min({{'s': split, 'p': position}}) AS first
    FROM ({SELECTED_SQL}) GROUP BY ALL HAVING count(*) >= 3"""


@query("majority_vote", f"SELECT run, feature, votes, first.s AS first_split, first.p AS first_position FROM ({VOTED_SQL})")
def majority_vote(spark, sf):
    voted = selection.majority_vote(selected(spark, sf), 4, RUN)
    return voted.select(
        "run", "feature", "votes", F.col("first_seen.split").alias("first_split"),
        F.col("first_seen.position").alias("first_position"),
    )


@query("selection_frequency", f"SELECT feature, count(*) AS times FROM ({SELECTED_SQL}) GROUP BY 1")
def selection_frequency(spark, sf):
    return selection.selection_frequency(selected(spark, sf))


@query("prune_accept", f"""
    WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS run, o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY ALL),
    b AS (SELECT run, list(o_orderpriority) AS before FROM p WHERE top > 498000 GROUP BY 1),
    v AS (SELECT run, list(feature) AS voted FROM ({VOTED_SQL}) GROUP BY 1)
    SELECT run, len(list_filter(voted, lambda x: NOT list_contains(before, x))) = 0 AND len(voted) < len(before) AS accepted
    FROM b JOIN v USING (run)""")
def prune_accept(spark, sf):
    tops = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("run"), "o_orderpriority").agg(
        F.max("o_totalprice").alias("top")
    )
    before = tops.where("top > 498000").groupBy("run").agg(F.collect_set("o_orderpriority").alias("before"))
    voted = selection.majority_vote(selected(spark, sf), 4, RUN).groupBy("run").agg(
        F.collect_set("feature").alias("voted")
    )
    return col_ops.prune_accept_rows(before.join(voted, "run"), "before", "voted").select("run", "accepted")
