"""Sources and sinks: each round trip writes a table of the inputs and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import kfold_rows_sql, table
from columnwright.catalog.ledgers import SELECTED_SQL, selected
from columnwright.catalog.registry import query
from columnwright.operators import splits
from columnwright.plans.specs import validate_suggestions
from columnwright.sources import arff, records, sinks
from columnwright.storage import fresh_path


@query("arff_read", """
    SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS "account balance", c_mktsegment || ', ''x''' AS segment
    FROM customer""")
def arff_read(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("account balance"),
        F.concat("c_mktsegment", F.lit(", 'x'")).alias("segment"),
    )
    path = fresh_path(spark, "arff")
    sinks.write_arff(df, "customer", path, ["customers with an account"])
    return arff.read_arff(spark, path)


@query("arff_comments", "SELECT trim(p_name || ' %' || p_brand) AS comment FROM part")
def arff_comments(spark, sf):
    path = fresh_path(spark, "comments")
    line = F.concat(F.lit("%%  "), "p_name", F.lit(" %"), "p_brand")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return arff.read_comments(spark, path).select("comment")


# ------------------------------------------------------------- JSON replies


def _replies(spark, sf):
    """One reply per part, suggesting two columns."""
    part = table(spark, sf, "part")
    name = F.concat(F.lit("size_"), "p_type")
    method = (
        F.when(F.col("p_size") % 4 == 0, F.lit("df['a'] = df['p_size'] * df['class']"))
        .when(F.col("p_size") % 4 == 1, F.lit("df['b'] = df['class_size'] + df['p_size']"))
        .otherwise(F.lit("df['c'] = pd.cut(df['p_size'], 4)"))
    )
    suggestion = lambda name, method: F.struct(
        name.alias("name"), F.col("p_name").alias("description"), method.alias("generation_method"),
        F.col("p_brand").alias("value_example"), F.lit("size matters").alias("reasoning"),
    )
    both = F.array(
        suggestion(name, method), suggestion(F.lit("p_brand"), F.lit("df['p_brand'] = 1"))
    )
    return part.select("p_partkey", "p_brand", F.to_json(F.struct(both.alias("columns"))).alias("reply"))


METHOD_SQL = """CASE WHEN p_size % 4 = 0 THEN 'df[''a''] = df[''p_size''] * df[''class'']'
    WHEN p_size % 4 = 1 THEN 'df[''b''] = df[''class_size''] + df[''p_size'']' ELSE 'df[''c''] = pd.cut(df[''p_size''], 4)' END"""
SUGGESTED_SQL = f"""
    SELECT p_partkey, 0 AS position, 'size_' || p_type AS name, p_name AS description, {METHOD_SQL} AS generation_method,
           p_brand AS value_example, 'size matters' AS reasoning FROM part
    UNION ALL SELECT p_partkey, 1, 'p_brand', p_name, 'df[''p_brand''] = 1', p_brand, 'size matters' FROM part"""


@query("suggestions_ingest", SUGGESTED_SQL)
def suggestions_ingest(spark, sf):
    return records.suggestions(_replies(spark, sf), "reply", ["p_partkey"])


@query("specs_validate", f"""
    WITH s AS (SELECT value_example AS brand, p_partkey * 2 + position AS position, name, generation_method FROM ({SUGGESTED_SQL})),
    m AS (SELECT *, regexp_matches(generation_method, '(^|[^A-Za-z0-9_])class([^A-Za-z0-9_]|$)') AS t, name = 'p_brand' AS e FROM s),
    f AS (SELECT brand, name, min(position) AS first FROM m WHERE NOT t AND NOT e GROUP BY ALL)
    SELECT m.brand, m.position, m.name, m.generation_method,
           CASE WHEN t THEN 'uses_target' WHEN e OR m.position > f.first THEN 'exists' ELSE 'ok' END AS status,
           m.generation_method LIKE '%] * df%' OR m.generation_method LIKE '%] + df%' AS plain_arithmetic
    FROM m LEFT JOIN f ON m.brand = f.brand AND m.name = f.name""")
def specs_validate(spark, sf):
    found = records.suggestions(_replies(spark, sf), "reply", ["p_partkey", "p_brand"])
    rows = found.select(
        F.col("p_brand").alias("brand"), (F.col("p_partkey") * 2 + F.col("position")).alias("position"),
        "name", "generation_method",
    )
    return validate_suggestions(rows, ["p_brand", "p_size"], "class", ["brand"])


@query("domain_context_ingest", """
    SELECT s_suppkey, 'trade' AS primary_domain, 'nation ' || s_nationkey AS important_metadata, u.c AS "column", u.d AS description
    FROM (SELECT *, unnest([{'c': 's_name', 'd': s_name}, {'c': 's_nationkey', 'd': 'key ' || s_nationkey}]) AS u FROM supplier)""")
def domain_context_ingest(spark, sf):
    described = F.create_map(
        F.lit("s_name"), F.col("s_name"), F.lit("s_nationkey"), F.concat(F.lit("key "), "s_nationkey")
    )
    reply = F.to_json(F.struct(
        F.lit("trade").alias("primary_domain"), described.alias("column_descriptions"),
        F.concat(F.lit("nation "), "s_nationkey").alias("important_metadata"),
    ))
    replies = table(spark, sf, "supplier").select("s_suppkey", reply.alias("reply"))
    contexts = records.domain_contexts(replies, "reply", ["s_suppkey"])
    return records.column_descriptions(contexts, ["s_suppkey", "primary_domain", "important_metadata"])


@query("kg_request_ingest", """
    SELECT p_partkey, 'What is the ' || p_type || ' of ' || p_name || '?' AS prompt, p_name AS "column", p_type AS relation
    FROM part""")
def kg_request_ingest(spark, sf):
    reply = F.to_json(F.struct(
        F.concat(F.lit("What is the "), "p_type", F.lit(" of "), "p_name", F.lit("?")).alias("prompt"),
        F.col("p_name").alias("column"), F.col("p_type").alias("relation"),
    ))
    replies = table(spark, sf, "part").select("p_partkey", reply.alias("reply"))
    return records.kg_requests(replies, "reply", ["p_partkey"])


@query("kg_bindings", """
    SELECT s_suppkey, s_name AS subject, 'nation ' || s_nationkey AS object FROM supplier
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def kg_bindings(spark, sf):
    cell = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    full = F.create_map(
        F.lit("subject"), cell("uri", F.col("s_name")),
        F.lit("object"), cell("literal", F.concat(F.lit("nation "), "s_nationkey")),
    )
    unbound = F.create_map(F.lit("subject"), cell("uri", F.col("s_name")))
    answer = F.to_json(F.struct(F.struct(F.array(full, unbound).alias("bindings")).alias("results")))
    answers = table(spark, sf, "supplier").select("s_suppkey", answer.alias("answer"))
    return records.kg_bindings(answers, "answer", ["subject", "object"], ["s_suppkey"])


# ------------------------------------------------------------- sinks


@query("sink_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sink_roundtrip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = fresh_path(spark, "csv")
    sinks.write_table(df, path, "csv")
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("fold_sink_roundtrip", f"""
    SELECT o_orderkey, fold FROM ({kfold_rows_sql('SELECT o_orderkey FROM orders', ['o_orderkey'], 5)})""")
def fold_sink_roundtrip(spark, sf):
    df = splits.kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    path = fresh_path(spark, "folds")
    sinks.write_folds(df, ["o_orderkey"], path)
    return spark.read.schema("o_orderkey bigint, fold int").parquet(path)


@query("selected_sink_roundtrip", f"SELECT split, position, feature FROM ({SELECTED_SQL})")
def selected_sink_roundtrip(spark, sf):
    df = selected(spark, sf)
    path = fresh_path(spark, "selected")
    for part in (0, 1):
        sinks.append_selected(df.where(F.col("split") % 2 == part), path)
    return sinks.read_selected(spark, path)


@query("selected_splits_roundtrip", f"SELECT run, split, position, feature FROM ({SELECTED_SQL})")
def selected_splits_roundtrip(spark, sf):
    """One folder per split of each run (a year, a quarter); every split is written twice."""
    path = fresh_path(spark, "selected")
    chosen = {}
    # Three features a quarter.
    for r in selected(spark, sf).orderBy("run", "split", "position").collect():
        chosen.setdefault((r["run"], r["split"]), []).append(r["feature"])
    for (run, split), features in chosen.items():
        for written in (["stale", *features], features):
            sinks.write_selected_split(spark, split, written, f"{path}/run={run}")
    read = spark.read.schema("position int, feature string, run int, split int").json(path)
    return read.select("run", "split", "position", "feature")


@query("ledger_roundtrip", """
    SELECT CAST(month(o_orderdate) AS INTEGER) AS round, o_orderstatus AS status, count(*) AS n,
           CAST(avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS DOUBLE) AS score_pruned
    FROM orders GROUP BY ALL""")
def ledger_roundtrip(spark, sf):
    rows = table(spark, sf, "orders").groupBy(
        F.month("o_orderdate").alias("round"), F.col("o_orderstatus").alias("status")
    ).agg(
        F.count(F.lit(1)).cast("string").alias("suggestions"),
        F.array(F.max("o_orderpriority")).alias("selected"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("score_pruned"),
        F.lit(None).cast("double").alias("score_before"), F.lit(None).cast("double").alias("score_added"),
        F.lit(False).alias("accepted"),
    ).select("round", "status", "suggestions", "selected", "score_before", "score_added", "score_pruned", "accepted")
    path = fresh_path(spark, "ledger")
    sinks.append_ledger(rows, path)
    return sinks.read_ledger(spark, path).select(
        "round", "status", F.col("suggestions").cast("bigint").alias("n"), "score_pruned"
    )
