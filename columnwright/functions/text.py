"""Text expressions: normalising, templates, classes found in model replies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def strip(column: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def normalise_label(column: Column) -> Column:
    return F.lower(column)


def normalise_reply(column: Column) -> Column:
    return F.upper(strip(column))


def decode_binary_columns(df: DataFrame) -> DataFrame:
    """Byte-string columns decoded as UTF-8."""
    return df.select(
        *[
            F.decode(F.col(f.name), "UTF-8").alias(f.name)
            if isinstance(f.dataType, T.BinaryType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def label_first_occurrence(reply: Column, classes: Sequence[str]) -> Column:
    """The class whose name occurs first in the reply; NULL if none does.

    Of two names at the same place, the one listed first wins.
    """
    if not classes:
        raise ValueError("at least one class is needed")
    text = F.lower(reply)
    found = [
        F.struct(F.nullif(F.locate(c.lower(), text), F.lit(0)).alias("at"), F.lit(i).alias("rank"),
                 F.lit(c.lower()).alias("name"))
        for i, c in enumerate(classes)
    ]
    hits = F.filter(F.array(*found), lambda s: s["at"].isNotNull())
    return F.array_min(hits)["name"]


def label_marker(reply: Column, begin: str, end: str) -> Column:
    """Trimmed lower-case text between the first pair of markers; NULL without one."""
    pattern = f"(?s){re.escape(begin)}(.*?){re.escape(end)}"
    return F.nullif(F.lower(strip(F.regexp_extract(reply, pattern, 1))), F.lit(""))


def render_template(template: str, columns: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places with row values; missing values print as ``null``.

    ``{{`` and ``}}`` stand for single braces.
    """
    pieces: list[Column] = []
    for part in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if part in ("{{", "}}"):
            pieces.append(F.lit(part[0]))
        elif re.fullmatch(r"\{\w+\}", part):
            pieces.append(F.coalesce(columns[part[1:-1]].cast("string"), F.lit("null")))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces) if pieces else F.lit("")
