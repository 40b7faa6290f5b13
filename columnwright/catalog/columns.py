"""Profiles, derived columns and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import kfold_rows_sql, table
from columnwright.catalog.registry import query
from columnwright.functions import missing, text
from columnwright.operators import columns as col_ops, knowledge, metrics, profile, profile_state, ranks, splits
from columnwright.plans import specs


def orders(spark, sf):
    return table(spark, sf, "orders")


def customer(spark, sf):
    return table(spark, sf, "customer")


# ------------------------------------------------------------- profiles

CUSTOMER_COLUMNS = {
    "c_custkey": ("bigint", True), "c_name": ("string", False), "c_nationkey": ("int", True),
    "c_acctbal": ("double", True), "c_mktsegment": ("string", False),
}


def _profile_sql(full: bool) -> str:
    rows = []
    for c, (kind, number) in CUSTOMER_COLUMNS.items():
        stats = ", ".join(
            f"round({f}({c}), 6) AS {a}" if number else f"CAST(NULL AS DOUBLE) AS {a}"
            for f, a in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_samp", "std"))
        )
        values = (
            "'continuous values'" if number else
            f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM customer WHERE {c} IS NOT NULL))"
        )
        extra = f"count(DISTINCT {c}) AS unique_count, {values} AS unique_values, " if full else ""
        rows.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, {extra}"
            f"count(*) - count({c}) AS missing_values, {stats} FROM customer"
        )
    out = " UNION ALL ".join(rows)
    cast = ", ".join(f"CAST({a} AS DOUBLE) AS {a}" for a in ("mean", "min", "max", "std"))
    return f"SELECT * REPLACE ({cast}) FROM ({out})"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "std")})


@query("profile", f"SELECT *, false AS list_omitted FROM ({_profile_sql(True)})")
def profile_query(spark, sf):
    found = profile.profile(customer(spark, sf))
    return _rounded(found).withColumn("unique_values", F.array_join("unique_values", ","))


@query("profile_numeric", _profile_sql(False))
def profile_numeric(spark, sf):
    return _rounded(profile.column_stats(customer(spark, sf)))


@query("profile_categorical", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM part WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("p_name", "p_brand", "p_type")
))
def profile_categorical(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("profile_json", """
    SELECT '[' || string_agg('{"column":"' || c || '","dtype":"' || d || '","unique_count":' || u || ',"missing_values":' || m || '}',
                             ',' ORDER BY c) || ']' AS profile
    FROM (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, '{kind}' AS d, count(DISTINCT {c}) AS u, count(*) - count({c}) AS m FROM customer"
        for c, (kind, _) in CUSTOMER_COLUMNS.items()) + ")")
def profile_json(spark, sf):
    found = profile.profile_counts(customer(spark, sf))
    return profile.profile_json(found, ["column", "dtype", "unique_count", "missing_values"])


PROFILED = ["column", "dtype", "unique_count", "missing_values", "mean", "min", "max", "std"]


@query("profile_combined", f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in PROFILED)} FROM ({_profile_sql(True)})")
def profile_combined(spark, sf):
    """The profile of all customers from the states of three parts."""
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(3))
    states = [profile_state.measure(customer(spark, sf).where(part == i)) for i in range(3)]
    return _rounded(profile_state.finish(profile_state.combine(states)))


@query("select_by_type", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_by_type(spark, sf):
    return col_ops.select_by_type(orders(spark, sf))


@query("distinct_classes", "SELECT DISTINCT lower(c_mktsegment) AS c_mktsegment FROM customer")
def distinct_classes(spark, sf):
    return metrics.distinct_classes(customer(spark, sf), "c_mktsegment")


# ------------------------------------------------------------- derived columns

def _spec_query(name, source, keep, spec, sql):
    """A query that applies one spec to a table and keeps the key and the new column."""

    @query(name, sql)
    def run(spark, sf):
        df = specs.apply_specs(table(spark, sf, source).select(*keep), [spec])
        return df.select(keep[0], spec["name"])

    return run


PRICE = ["o_orderkey", "o_totalprice"]
_spec_query(
    "bin_edges", "orders", PRICE,
    {"name": "band", "op": "bin_edges", "input": ["o_totalprice"],
     "args": {"edges": [0, 50_000, 150_000, 300_000], "labels": ["low", "middle", "high"]}},
    """SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low'
         WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'middle'
         WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high' END AS band FROM orders""",
)
_spec_query(
    "bin_equal_width", "orders", PRICE,
    {"name": "step", "op": "bin_equal_width", "input": ["o_totalprice"], "args": {"k": 7}},
    """SELECT o_orderkey, CAST(least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 7)) - 1, 0), 6) AS INTEGER) AS step
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""",
)
_spec_query(
    "bin_quantile", "orders", PRICE,
    {"name": "segment", "op": "bin_quantile", "input": ["o_totalprice"],
     "args": {"labels": ["low", "medium", "high", "vip"]}},
    """SELECT o_orderkey, CASE WHEN o_totalprice >= e[1] AND o_totalprice <= e[2] THEN 'low'
         WHEN o_totalprice > e[2] AND o_totalprice <= e[3] THEN 'medium'
         WHEN o_totalprice > e[3] AND o_totalprice <= e[4] THEN 'high'
         WHEN o_totalprice > e[4] AND o_totalprice <= e[5] THEN 'vip' END AS segment
       FROM orders, (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM orders)""",
)
_spec_query(
    "bin_fixed_width", "part", ["p_partkey", "p_size"],
    dict(specs.from_declarative(
        {"method": "Binning", "input_columns": ["p_size"], "output_column": "binned_size", "bin_size": 3})),
    "SELECT p_partkey, CAST(floor(p_size / 3.0) * 3 AS DOUBLE) AS binned_size FROM part",
)
_spec_query(
    "case_where", "orders", ["o_orderkey", "o_orderstatus"],
    {"name": "behaviour", "op": "case_where", "input": ["o_orderstatus"],
     "args": {"condition": "o_orderstatus = 'F'", "yes": "finished", "no": "running"}},
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS behaviour FROM orders",
)
_spec_query(
    "flag_conjunction", "customer", ["c_custkey", "c_nationkey", "c_acctbal"],
    {"name": "high_risk", "op": "flag_conjunction", "input": [],
     "args": {"conditions": ["c_nationkey < 12", "c_acctbal < 3000"]}},
    """SELECT c_custkey, CAST(coalesce(c_nationkey < 12 AND c_acctbal < 3000, false) AS INTEGER) AS high_risk
       FROM customer""",
)
_spec_query(
    "interaction_threshold", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity"],
    {"name": "discounted", "op": "interaction_threshold", "input": ["l_discount", "l_quantity"],
     "args": {"threshold": 0.05}},
    "SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END AS discounted FROM lineitem",
)
_spec_query(
    "case_rules", "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"],
    {"name": "lane", "op": "case_rules", "input": [],
     "args": {"rules": [["o_orderpriority = '1-URGENT'", "fast"], ["o_totalprice > 250000", "guarded"],
                        ["o_orderpriority = '2-HIGH'", "soon"]], "otherwise": "normal"}},
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fast' WHEN o_totalprice > 250000 THEN 'guarded'
         WHEN o_orderpriority = '2-HIGH' THEN 'soon' ELSE 'normal' END AS lane FROM orders""",
)


@query("pct_rank", """
    SELECT o_orderkey, round((cum - (cnt - 1) / 2.0) / n, 9) AS price_rank
    FROM orders JOIN (SELECT o_totalprice, cnt, sum(cnt) OVER (ORDER BY o_totalprice) AS cum, sum(cnt) OVER () AS n
                      FROM (SELECT o_totalprice, count(*) AS cnt FROM orders GROUP BY 1)) USING (o_totalprice)""")
def pct_rank(spark, sf):
    ranked = ranks.pct_rank(orders(spark, sf).select(*PRICE), "o_totalprice", "price_rank")
    return ranked.select("o_orderkey", F.round("price_rank", 9).alias("price_rank"))


@query("group_transform", """
    SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS customer_mean FROM orders""")
def group_transform(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    out = ranks.group_transform(df, ["o_custkey"], F.avg("o_totalprice"), "customer_mean")
    return out.select("o_orderkey", F.round("customer_mean", 4).alias("customer_mean"))


@query("group_median", """
    SELECT c_custkey, quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment) AS median,
           quantile_cont(c_acctbal, 0.9) OVER (PARTITION BY c_mktsegment) AS high FROM customer""")
def group_median(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = ranks.group_quantile(df, ["c_mktsegment"], "c_acctbal", 0.5, "median")
    out = ranks.group_quantile(out, ["c_mktsegment"], "c_acctbal", 0.9, "high")
    return out.select("c_custkey", "median", "high")


@query("group_median_lines", """
    SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price, quantile_cont(l_extendedprice, 0.25) AS low
    FROM lineitem GROUP BY ALL""")
def group_median_lines(spark, sf):
    """Few groups, each with a large share of all lines; ranges are narrowed several times."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    price = ranks.group_quantiles(df, keys, "l_extendedprice", 0.5).withColumnRenamed("quantile", "price")
    low = ranks.group_quantiles(df, keys, "l_extendedprice", 0.25).withColumnRenamed("quantile", "low")
    return price.join(low, keys)


def _with_gaps(df):
    """Balances with gaps: negative ones missing, those above 9000 infinite, 0..100 NaN."""
    value = (
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
        .when(F.col("c_acctbal") > 9000, F.lit(float("inf")))
        .when(F.col("c_acctbal") < 100, F.lit(float("nan")))
        .otherwise(F.col("c_acctbal"))
    )
    return df.select("c_custkey", value.alias("balance"), "c_mktsegment")


GAPS = "CASE WHEN c_acctbal >= 100 AND c_acctbal <= 9000 THEN c_acctbal END"


@query("impute_zero", f"SELECT c_custkey, coalesce({GAPS}, 0) AS balance, c_mktsegment FROM customer")
def impute_zero(spark, sf):
    return missing.impute_zero(_with_gaps(customer(spark, sf)))


@query("inf_to_null", f"SELECT c_custkey, {GAPS} AS balance, c_mktsegment FROM customer")
def inf_to_null(spark, sf):
    return missing.inf_to_null(_with_gaps(customer(spark, sf)))


@query("category_codes", """
    SELECT c_custkey, CAST(coalesce(dense_rank() OVER (ORDER BY c_name) - 1, -1) AS INTEGER) AS name_code,
           CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS segment_code FROM customer""")
def category_codes(spark, sf):
    df = customer(spark, sf).select("c_custkey", "c_name", "c_mktsegment")
    coded = ranks.category_codes(df, "c_name", "name_code")
    return ranks.category_codes(coded, "c_mktsegment", "segment_code").drop("c_name", "c_mktsegment")


@query("category_codes_per_fold", f"""
    WITH f AS ({kfold_rows_sql('SELECT o_orderkey, o_custkey FROM orders', ['o_orderkey'], 5)}),
    v AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM (SELECT DISTINCT o_custkey FROM f)),
    i AS (SELECT o_custkey, fold, count(*) AS inside FROM f GROUP BY ALL),
    t AS (SELECT o_custkey, sum(inside) AS total FROM i GROUP BY ALL)
    SELECT f.o_orderkey, f.fold, CAST(CASE WHEN total > inside THEN code ELSE -1 END AS INTEGER) AS customer_code
    FROM f JOIN v USING (o_custkey) JOIN i USING (o_custkey, fold) JOIN t USING (o_custkey)""")
def category_codes_per_fold(spark, sf):
    df = splits.kfold(orders(spark, sf).select("o_orderkey", "o_custkey"), ["o_orderkey"], 5)
    return ranks.category_codes_per_fold(df, "o_custkey", "customer_code").drop("o_custkey")


@query("to_feature_matrix", """
    SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_suppkey AS DOUBLE) AS l_suppkey, l_quantity
    FROM lineitem""")
def to_feature_matrix(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return missing.to_feature_matrix(df, ["l_linenumber", "l_suppkey", "l_quantity"])


@query("text_normalise", """
    SELECT p_partkey, lower(p_name) AS label, upper(trim('  ' || p_type || ' ')) AS reply FROM part""")
def text_normalise(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", text.normalise_label(F.col("p_name")).alias("label"),
        text.normalise_reply(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("reply"),
    )


@query("render_template", """
    SELECT p_partkey, 'Part ' || p_partkey || ' {' || p_name || '} is made by ' || p_brand || ', size ' || p_size || '.' AS prompt
    FROM part""")
def render_template(spark, sf):
    filled = text.render_template(
        "Part {key} {{{name}}} is made by {brand}, size {size}.",
        {"key": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")},
    )
    return table(spark, sf, "part").select("p_partkey", filled.alias("prompt"))


# ------------------------------------------------------------- batches of specs

BATCH = [
    {"name": "band", "op": "bin_edges", "input": ["o_totalprice"],
     "args": {"edges": [0, 100_000, 250_000, 500_000], "labels": ["low", "middle", "high"]}},
    {"name": "urgent", "op": "flag_conjunction", "input": [],
     "args": {"conditions": ["o_orderpriority = '1-URGENT'", "o_totalprice > 100000"]}},
    {"name": "status_text", "op": "mapping", "input": ["o_orderstatus"],
     "args": {"mapping": {("F",): "finished", ("O",): "open"}}},
    {"name": "customer_orders", "op": "group_transform", "input": ["o_orderkey"],
     "args": {"by": ["o_custkey"], "agg": "count"}},
    {"name": "busy", "op": "case_where", "input": ["customer_orders"],
     "args": {"condition": "customer_orders > 10", "yes": "busy", "no": "calm"}},
    {"name": "month", "op": "expr", "input": ["o_orderdate"], "args": {"sql": "month(o_orderdate)"}},
]


@query("apply_specs", """
    SELECT o_orderkey,
           CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice <= 250000 THEN 'middle'
                WHEN o_totalprice > 250000 AND o_totalprice <= 500000 THEN 'high' END AS band,
           CAST(o_orderpriority = '1-URGENT' AND o_totalprice > 100000 AS INTEGER) AS urgent,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status_text,
           count(*) OVER (PARTITION BY o_custkey) AS customer_orders,
           CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 10 THEN 'busy' ELSE 'calm' END AS busy,
           CAST(month(o_orderdate) AS INTEGER) AS month
    FROM orders""")
def apply_specs(spark, sf):
    kept, _ = specs.validate(BATCH, orders(spark, sf).columns)
    out = specs.apply_specs(orders(spark, sf), kept)
    return out.select("o_orderkey", *[s["name"] for s in kept])


ROUNDS = [
    [{"name": "tier", "op": "case_where", "input": [], "args": {"condition": "o_totalprice > 200000", "yes": 1, "no": 0}},
     {"name": "open", "op": "flag_conjunction", "input": [], "args": {"conditions": ["o_orderstatus = 'O'"]}}],
    [{"name": "tier", "op": "case_where", "input": [], "args": {"condition": "o_totalprice > 400000", "yes": 2, "no": 0}},
     {"name": "o_custkey", "op": "expr", "input": [], "args": {"sql": "0"}}],
]


@query("accumulate_columns", """
    SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 2 ELSE 0 END AS tier,
           CAST(o_orderstatus = 'O' AS INTEGER) AS open FROM orders""")
def accumulate_columns(spark, sf):
    df = orders(spark, sf)
    return specs.accumulate(df, ROUNDS).select("o_orderkey", "o_custkey", "tier", "open")


# ------------------------------------------------------------- lookups

@query("map_single_key", """
    SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7)
    ON c_nationkey = n_nationkey""")
def map_single_key(spark, sf):
    nations = table(spark, sf, "nation").where("n_nationkey <> 7").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value")
    )
    df = customer(spark, sf).select("c_custkey", "c_nationkey")
    return knowledge.map_values(df, ["c_nationkey"], nations, "nation").drop("c_nationkey")


FLAGS = {("A", "F"): "returned", ("R", "F"): "refused", ("N", "O"): "shipped"}


@query("map_composite_key", """
    SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'returned'
        WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'refused'
        WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'shipped' END AS fate FROM lineitem""")
def map_composite_key(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    on = ["l_returnflag", "l_linestatus"]
    return knowledge.map_values(df, on, knowledge.mapping_frame(df, on, FLAGS), "fate").drop(*on)


def _facts(spark, sf):
    """(subject, relation, object): a nation's region and its suppliers."""
    nation = table(spark, sf, "nation")
    region = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("subject"), F.lit("region").alias("relation"), F.col("r_name").alias("object")
    )
    supplier = nation.join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("subject"), F.lit("supplier").alias("relation"), F.col("s_name").alias("object")
    )
    return region.unionByName(supplier)


@query("kg_enrich", """
    SELECT c_custkey, n_name AS nation, r_name AS region, 1::BIGINT AS region_count, s.supplier,
           coalesce(s.supplier_count, 0) AS supplier_count
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT s_nationkey, min(s_name) AS supplier, count(*) AS supplier_count FROM supplier GROUP BY 1) s
      ON s.s_nationkey = n_nationkey""")
def kg_enrich(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value"))
    df = knowledge.map_values(customer(spark, sf).select("c_custkey", "c_nationkey"), ["c_nationkey"], nation, "nation")
    return knowledge.enrich(df, "nation", _facts(spark, sf), ["region", "supplier"]).drop("c_nationkey")


@query("kg_query_values", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def kg_query_values(spark, sf):
    return knowledge.query_values(orders(spark, sf), "o_custkey")


@query("kg_novelty", """
    SELECT p_partkey, p_brand AS "column", p_type AS relation FROM part p
    WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size > 48 AND q.p_brand = p.p_brand AND q.p_type = p.p_type)""")
def kg_novelty(spark, sf):
    part = table(spark, sf, "part")
    named = part.select("p_partkey", F.col("p_brand").alias("column"), F.col("p_type").alias("relation"))
    sizes = part.groupBy(F.col("p_brand").alias("column"), F.col("p_type").alias("relation")).agg(
        F.max("p_size").alias("size")
    )
    asked = sizes.where("size > 48")
    return knowledge.novel_requests(named, asked)
