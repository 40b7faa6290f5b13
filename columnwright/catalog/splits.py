"""Splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import (
    fold_sql, hash_sql, index_sql, kfold_rows_sql, stratified_fold_sql, stratified_split_sql, table,
)
from columnwright.catalog.registry import query
from columnwright.operators import columns as col_ops, metrics, splits

KEY = ["o_orderkey"]
ORDERS = "SELECT * FROM orders"
IDX = index_sql(KEY, 42)
INDEXED = f"SELECT *, {IDX} AS idx, count(*) OVER () AS n FROM orders"


def orders(spark, sf):
    return table(spark, sf, "orders")


@query("kfold_assign", f"SELECT o_orderkey, fold FROM ({kfold_rows_sql(ORDERS, KEY, 10)})")
def kfold_assign(spark, sf):
    return splits.kfold(orders(spark, sf).select("o_orderkey"), KEY, 10)


@query("kfold_stratified_repeated", " UNION ALL ".join(
    f"SELECT o_orderkey, o_orderstatus, {r} AS repeat, fold FROM "
    f"({stratified_fold_sql(ORDERS, KEY, 'o_orderstatus', 3, 42 + r)})" for r in range(2)
))
def kfold_stratified_repeated(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return splits.repeated_stratified_kfold(df, KEY, "o_orderstatus", 3, 2)


@query("split_stratified",
       f"SELECT o_orderkey, o_orderstatus, is_test FROM ({stratified_split_sql(ORDERS, KEY, 'o_orderstatus')})")
def split_stratified(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return splits.split_stratified(df, KEY, "o_orderstatus")


@query("train_test_complement",
       f"SELECT o_orderkey, o_totalprice FROM ({INDEXED}) WHERE idx >= round_even(0.8 * n, 0)")
def train_test_complement(spark, sf):
    df = splits.split_random(orders(spark, sf).select("o_orderkey", "o_totalprice"), KEY, 0.8)
    return df.where(~F.col("is_train")).drop("is_train")


@query("cv_split_rows",
       f"SELECT o_orderkey, o_totalprice FROM ({INDEXED}) WHERE {fold_sql(10)} = 3")
def cv_split_rows(spark, sf):
    df = splits.kfold(orders(spark, sf).select("o_orderkey", "o_totalprice"), KEY, 10)
    return df.where("fold = 3").drop("fold")


@query("subsample_n", f"SELECT o_orderkey, o_custkey FROM ({INDEXED}) WHERE idx < 30")
def subsample_n(spark, sf):
    return splits.subsample(orders(spark, sf).select("o_orderkey", "o_custkey"), KEY, "subsample", 30)


@query("subsample_cap", f"SELECT o_orderkey, o_custkey FROM ({INDEXED}) WHERE idx < 10000")
def subsample_cap(spark, sf):
    return splits.subsample_cap(orders(spark, sf).select("o_orderkey", "o_custkey"), KEY, 10_000)


@query("subsample_random_block", f"""
    SELECT o_orderkey, o_custkey FROM ({INDEXED})
    WHERE idx // 30 = (42 * {splits.SPREAD}) % 4294967296 % (n // 30)""")
def subsample_random_block(spark, sf):
    return splits.subsample(orders(spark, sf).select("o_orderkey", "o_custkey"), KEY, "random_block", 30)


@query("subsample_sequential_block", f"""
    SELECT o_orderkey, o_custkey FROM ({INDEXED}) WHERE idx // 30 = 1234567 % (n // 30)""")
def subsample_sequential_block(spark, sf):
    return splits.subsample(
        orders(spark, sf).select("o_orderkey", "o_custkey"), KEY, "sequential_block", 30, 1234567
    )


@query("block_count", "SELECT count(*) // 30 AS n_blocks FROM orders")
def block_count(spark, sf):
    return metrics.block_count(orders(spark, sf), 30)


@query("pop_rows", f"""
    SELECT o_orderkey, o_custkey, CASE WHEN idx < CAST(floor(n * 0.15) AS BIGINT) THEN 'popped' ELSE 'rest' END AS part
    FROM ({INDEXED})""")
def pop_rows(spark, sf):
    popped, rest = splits.pop_rows(orders(spark, sf).select("o_orderkey", "o_custkey"), KEY, frac=0.15)
    return popped.withColumn("part", F.lit("popped")).unionByName(rest.withColumn("part", F.lit("rest")))


@query("sample_row", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY {hash_sql(KEY, 42)} LIMIT 1")
def sample_row(spark, sf):
    return splits.sample_row(orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus"), KEY)


@query("xy_split", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def xy_split(spark, sf):
    df = orders(spark, sf).drop("o_orderdate")
    features, labels = col_ops.xy_split(df, KEY, "o_orderstatus")
    return features.join(labels, "o_orderkey")


@query("project_selected", "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def project_selected(spark, sf):
    return col_ops.project_selected(
        orders(spark, sf), KEY, ["o_totalprice", "o_orderpriority"], "o_orderstatus"
    )


@query("class_counts", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def class_counts(spark, sf):
    return metrics.class_counts(orders(spark, sf), "o_orderstatus")
