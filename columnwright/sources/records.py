"""JSON replies as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SUGGESTIONS = (
    "columns array<struct<name string, description string, generation_method string, "
    "value_example string, reasoning string>>"
)
DOMAIN = (
    "primary_domain string, column_descriptions map<string,string>, important_metadata string"
)
REQUEST = "prompt string, `column` string, relation string"
BINDINGS = "results struct<bindings array<map<string, struct<type string, value string>>>>"
STRICT = {"mode": "FAILFAST"}


def suggestions(replies: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per suggested column, with its position in the reply."""
    parsed = replies.select(*keep, F.from_json(json, SUGGESTIONS, STRICT)["columns"].alias("c"))
    return parsed.select(*keep, F.posexplode("c").alias("position", "s")).select(
        *keep, "position", "s.*"
    )


def domain_contexts(replies: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """Domain, metadata and the map of column descriptions."""
    return replies.select(*keep, F.from_json(json, DOMAIN, STRICT).alias("d")).select(*keep, "d.*")


def column_descriptions(contexts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per described column."""
    return contexts.select(*keep, F.explode("column_descriptions").alias("column", "description"))


def kg_requests(replies: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prompt, column and relation of each knowledge-graph request."""
    return replies.select(*keep, F.from_json(json, REQUEST, STRICT).alias("d")).select(*keep, "d.*")


def kg_bindings(
    answers: DataFrame, json: str, variables: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per binding with the value of each variable; unbound variables are NULL."""
    parsed = answers.select(
        *keep, F.explode(F.from_json(json, BINDINGS, STRICT)["results"]["bindings"]).alias("b")
    )
    return parsed.select(*keep, *[F.try_element_at("b", F.lit(v))["value"].alias(v) for v in variables])
