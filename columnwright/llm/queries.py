"""One query per operator, over its whole tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from columnwright.llm import fingerprints as fingerprinting
from columnwright.llm import importance, languages, linerules, mixing, packing, prefixtrie, ranking, simhash, suffixes, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)
# Addresses of pages with this notice are on the block list.
NOTICE = "Licensed under"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal(table(spark, sf_dir, "documents"))


@query("op3_importance_resampling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_line_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return linerules.score_documents(documents, linerules.train(documents, table(spark, sf_dir, "labels")))


@query("op7_weighted_sampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinting.edited_likeness(table(spark, sf_dir, "documents"))


@query("op8_url_cascade", f"""
WITH parts AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
listed AS (SELECT DISTINCT host || path AS key FROM split WHERE contains(html, '{NOTICE}')),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.noticed_addresses(pages, NOTICE))


@query("op9_temperature_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(table(spark, sf_dir, "documents")).select(
        F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"),
        mixing.tokens(F.col("__row.text")).alias("n_tokens"), "weight", "epoch", "block", "place",
    )


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_language_spans")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = languages.identify(documents, languages.train(documents))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op13_dual_tree_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def corpus() -> object:
    """The pipeline module at the top of the repository."""
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    import corpus_pipeline

    return corpus_pipeline


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return corpus().run(spark, sf_dir)
