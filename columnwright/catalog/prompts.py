"""Prompt scoring on the conversation turns: text is the input, the role is the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import hash_sql, table
from columnwright.catalog.registry import query
from columnwright.functions import text
from columnwright.operators import metrics, prompts as ops
from columnwright.operators.prediction_cache import PredictionCache
from columnwright.plans import experiment
from columnwright.storage import fresh_path

KEYS = ["conv_id", "turn"]
PROMPTS = ["Who wrote this turn?", "Name the role of the speaker.", "Is it user, assistant or system?"]
CLASSES = ["user", "assistant", "system"]
PROMPT_ROWS = ", ".join(f"('{p}')" for p in PROMPTS)
TASK_SQL = "SELECT conv_id, turn, text AS x, lower(role) AS y FROM conversations"
PAIRS_SQL = f"SELECT prompt, conv_id, turn, x, y FROM ({TASK_SQL}), (VALUES {PROMPT_ROWS}) p(prompt)"
CACHED_SQL = f"""
    SELECT DISTINCT prompt, x, y, CASE WHEN length(x) > 300 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, 'seq ' || length(x) AS sequence
    FROM ({PAIRS_SQL}) WHERE y = 'user' AND prompt <> '{PROMPTS[2]}'"""


def task(spark, sf):
    return ops.text_task(table(spark, sf, "conversations"), KEYS, "text", "role")


def cache(spark, sf):
    """Known scores of two prompts on the turns of users."""
    length = F.length("x")
    pairs = ops.pairs_cross(task(spark, sf), PROMPTS[:2]).where("y = 'user'")
    return pairs.select(
        *ops.PAIR, F.when(length > 300, 0.0).otherwise(1.0).alias("score"),
        F.concat(F.lit("seq "), length.cast("string")).alias("sequence"),
    ).distinct()


def predict(pairs):
    """A stand-in for a model: long turns are always taken for a user's."""
    wrong = F.length("x") + F.length("prompt") > 400
    role = F.when(wrong, F.lit("user")).otherwise(F.col("y"))
    reply = F.concat(F.lit("I think so. <role> "), F.initcap(role), F.lit(" </role>"))
    return pairs.withColumn("sequence", reply).withColumn(
        "prediction", text.label_marker(F.col("sequence"), "<role>", "</role>")
    )


PREDICTED = "CASE WHEN (length(x) + length(prompt)) > 400 THEN 'user' ELSE y END"


@query("pairs_cross", f"SELECT prompt, conv_id, turn, md5(x) AS x, y FROM ({PAIRS_SQL})")
def pairs_cross(spark, sf):
    return ops.pairs_cross(task(spark, sf), PROMPTS).withColumn("x", F.md5("x"))


@query("pairs_to_predict", f"""
    SELECT prompt, conv_id, turn, md5(x) AS x, y FROM ({PAIRS_SQL}) p
    WHERE NOT EXISTS (SELECT 1 FROM ({CACHED_SQL}) c WHERE c.prompt = p.prompt AND c.x = p.x AND c.y = p.y)""")
def pairs_to_predict(spark, sf):
    pairs = ops.pairs_cross(task(spark, sf), PROMPTS)
    return ops.pairs_to_predict(pairs, cache(spark, sf)).withColumn("x", F.md5("x"))


@query("cache_collect", f"""
    SELECT p.prompt, conv_id, turn, p.y, score, sequence FROM ({PAIRS_SQL}) p
    LEFT JOIN ({CACHED_SQL}) c ON c.prompt = p.prompt AND c.x = p.x AND c.y = p.y""")
def cache_collect(spark, sf):
    pairs = ops.pairs_cross(task(spark, sf), PROMPTS)
    return ops.cache_collect(pairs, cache(spark, sf)).select("prompt", *KEYS, "y", "score", "sequence")


SCORES_SQL = f"""
    SELECT p.prompt, round(avg(coalesce(c.score, CASE WHEN {PREDICTED.replace('x)', 'p.x)').replace('(prompt', '(p.prompt').replace('ELSE y', 'ELSE p.y')} = p.y
                                     THEN 1.0 ELSE 0.0 END)), 6) AS score
    FROM ({PAIRS_SQL}) p LEFT JOIN ({CACHED_SQL}) c ON c.prompt = p.prompt AND c.x = p.x AND c.y = p.y GROUP BY 1"""


@query("prompt_scores", SCORES_SQL)
def prompt_scores(spark, sf):
    collected, _ = experiment.evaluate(task(spark, sf), KEYS, PROMPTS, predict, cache(spark, sf))
    return ops.prompt_scores(collected).withColumn("score", F.round("score", 6))


def bucketed(spark, sf):
    """The same cache, kept in buckets by pair."""
    made = PredictionCache.open(spark, fresh_path(spark, "predictions"), buckets=16)
    made.add(cache(spark, sf))
    return made


@query("cache_bucketed", f"""
    SELECT DISTINCT prompt, md5(x) AS x, y FROM ({PAIRS_SQL}) p
    WHERE NOT EXISTS (SELECT 1 FROM ({CACHED_SQL}) c WHERE c.prompt = p.prompt AND c.x = p.x AND c.y = p.y)""")
def cache_bucketed(spark, sf):
    """Pairs that a cache in buckets lacks."""
    pairs = ops.pairs_cross(task(spark, sf), PROMPTS)
    return bucketed(spark, sf).missing(pairs).withColumn("x", F.md5("x"))


@query("prompt_scores_bucketed", SCORES_SQL)
def prompt_scores_bucketed(spark, sf):
    collected, _ = experiment.evaluate(task(spark, sf), KEYS, PROMPTS, predict, bucketed(spark, sf))
    return ops.prompt_scores(collected).withColumn("score", F.round("score", 6))


@query("prompt_leaderboard", f"""
    SELECT prompt, round(avg(CASE WHEN {PREDICTED} = y THEN 1.0 ELSE 0.0 END), 6) AS score
    FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql(KEYS, 42)}) - 1 AS idx,
                         count(*) OVER () AS n FROM ({TASK_SQL})) WHERE idx >= round_even(0.8 * n, 0)),
         (VALUES {PROMPT_ROWS}) p(prompt) GROUP BY 1""")
def prompt_leaderboard(spark, sf):
    ranked = experiment.run_experiment(task(spark, sf), KEYS, PROMPTS, predict)
    return ranked.withColumn("score", F.round("score", 6))


def exemplar_sql(seeds, n=3):
    marks = ", ".join(f"('{p}', {s})" for p in PROMPTS for s in seeds)
    return f"""
    SELECT prompt, CAST(seed AS INTEGER) AS seed,
           string_agg('Input: ' || x || chr(10) || 'Output: ' || y, chr(10) || chr(10) ORDER BY r) || chr(10) || chr(10) || prompt AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY prompt, seed
              ORDER BY md5(concat_ws('|', {hash_sql(KEYS)}, prompt, seed)), conv_id, turn) AS r
          FROM ({TASK_SQL}), (VALUES {marks}) m(prompt, seed)) WHERE r <= {n} GROUP BY prompt, seed"""


@query("exemplars_random", f"SELECT * FROM ({exemplar_sql([42])})")
def exemplars_random(spark, sf):
    return ops.exemplars_random(task(spark, sf), KEYS, PROMPTS, 3)


def predict_by_text(pairs):
    """A stand-in for a model that gets other rows wrong for other prompts."""
    wrong = (F.length("x") * 7 + F.length("prompt")) % 5 == 0
    return pairs.withColumn("prediction", F.when(wrong, F.lit("nobody")).otherwise(F.col("y"))).withColumn(
        "sequence", F.col("prediction")
    )


RACE_SEEDS, FIRST_ROWS = [1, 2, 3, 4], 100


def race_sql(then):
    """The rungs of the race unrolled: rows in hash order, twice as many each time, half of the seeds gone each time."""
    right = "CASE WHEN (length(x) * 7 + length(text)) % 5 = 0 THEN 0.0 ELSE 1.0 END"
    order = hash_sql(KEYS, 42)
    scored = lambda left, size: f"""
        SELECT c.prompt, c.seed, c.text, avg({right}) AS score FROM {left} c, ordered t
        WHERE idx < {size} GROUP BY ALL"""
    kept = lambda source, n: f"""
        SELECT prompt, seed, text FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, seed) AS r FROM {source}) WHERE r <= {n}"""
    return f"""
    WITH ordered AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS idx, count(*) OVER () AS n FROM ({TASK_SQL})),
    c0 AS ({exemplar_sql(RACE_SEEDS)}),
    s0 AS ({scored("c0", FIRST_ROWS)}), c1 AS ({kept("s0", "CASE WHEN (SELECT max(n) FROM ordered) > 100 THEN 2 ELSE 4 END")}),
    s1 AS ({scored("c1", 2 * FIRST_ROWS)}), c2 AS ({kept("s1", "CASE WHEN (SELECT max(n) FROM ordered) > 200 THEN 1 ELSE 4 END")}),
    s2 AS (SELECT c.prompt, c.seed, c.text, avg({right}) AS score FROM c2 c, ordered t GROUP BY ALL)
    {then}"""


@query("exemplars_search", race_sql("""
    SELECT prompt, seed, text, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, seed) AS r FROM s2) WHERE r = 1"""))
def exemplars_search(spark, sf):
    race = experiment.race_exemplars(
        task(spark, sf), KEYS, PROMPTS, predict_by_text, 3, RACE_SEEDS, first_rows=FIRST_ROWS
    )
    return race.best.withColumn("score", F.round("score", 6))


@query("exemplar_rungs", race_sql(f"""
    , e0 AS (SELECT prompt, seed, 0 AS rung, least({FIRST_ROWS}, (SELECT max(n) FROM ordered)) AS n_rows, score FROM s0),
    e1 AS (SELECT prompt, seed, 1 AS rung, least({2 * FIRST_ROWS}, (SELECT max(n) FROM ordered)) AS n_rows, score FROM s1 WHERE (SELECT max(n) FROM ordered) > {FIRST_ROWS})
    SELECT prompt, seed, CAST(rung AS INTEGER) AS rung, CAST(n_rows AS BIGINT) AS rows, round(score, 6) AS score
    FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1)"""))
def exemplar_rungs(spark, sf):
    """What the candidates scored in the first two rungs."""
    race = experiment.race_exemplars(
        task(spark, sf), KEYS, PROMPTS, predict_by_text, 3, RACE_SEEDS, first_rows=FIRST_ROWS
    )
    return race.rungs.where("rung < 2").withColumn("score", F.round("score", 6))


@query("label_marker", f"""
    SELECT conv_id, turn, CASE WHEN y <> 'system' THEN {PREDICTED.replace('prompt', 'x')} END AS label FROM ({TASK_SQL})""")
def label_marker(spark, sf):
    role = F.when(F.length("x") + F.length("x") > 400, F.lit("user")).otherwise(F.col("y"))
    begin = F.when(F.col("y") != "system", F.lit("<role>\n")).otherwise(F.lit("role: "))
    reply = F.concat(F.col("x"), begin, F.upper(role), F.lit("\n</role> done </role>"))
    return task(spark, sf).select(*KEYS, text.label_marker(reply, "<role>", "</role>").alias("label"))


@query("label_first_occurrence", """
    WITH r AS (SELECT conv_id, turn, lower(text || CASE WHEN turn % 3 = 0 THEN ' The Assistant answers the user.'
                                          WHEN turn % 3 = 1 THEN ' USER and system' ELSE '' END) AS reply FROM conversations),
    p AS (SELECT *, nullif(strpos(reply, 'user'), 0) AS u, nullif(strpos(reply, 'assistant'), 0) AS a, nullif(strpos(reply, 'system'), 0) AS s FROM r)
    SELECT conv_id, turn, CASE WHEN u IS NULL AND a IS NULL AND s IS NULL THEN NULL
        WHEN coalesce(u, 1e9) = least(coalesce(u, 1e9), coalesce(a, 1e9), coalesce(s, 1e9)) THEN 'user'
        WHEN coalesce(a, 1e9) = least(coalesce(u, 1e9), coalesce(a, 1e9), coalesce(s, 1e9)) THEN 'assistant' ELSE 'system' END AS label
    FROM p""")
def label_first_occurrence(spark, sf):
    tail = (
        F.when(F.col("turn") % 3 == 0, F.lit(" The Assistant answers the user."))
        .when(F.col("turn") % 3 == 1, F.lit(" USER and system")).otherwise(F.lit(""))
    )
    reply = F.concat("x", tail)
    return task(spark, sf).select(*KEYS, text.label_first_occurrence(reply, CLASSES).alias("label"))
