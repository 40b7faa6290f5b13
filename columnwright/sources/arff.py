"""ARFF files as tables. A path may be one file or a folder of files with one header."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from columnwright.functions.text import strip

NUMERIC = {"numeric", "real", "integer"}
# Lines in which the header of a single file is looked for before the whole file is searched.
HEADER_LINES = 10_000
# Ways of writing one header that the files of a folder may have.
HEADERS = 1_000
ATTRIBUTE = re.compile(r"\s*@attribute\s", re.IGNORECASE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def arff_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names and types from the ``@attribute`` lines.

    The header at the start of a single file is found without reading further. The files
    of a folder are all searched, and every header there has to be the same; it may also
    lie in a file of its own. What reaches the driver is each way of writing it, once.
    """
    lines = _lines(spark, path)
    if len(lines.inputFiles()) == 1:
        first = [r["value"] for r in lines.take(HEADER_LINES)]
        ends = [i for i, line in enumerate(first) if line.strip().lower() == "@data"]
        header = [line for line in first[: ends[0]] if ATTRIBUTE.match(line)] if ends else []
        if header:
            return T.StructType([_field(line) for line in header])
    place = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    found = (
        lines.where(F.col("value").rlike(r"(?i)^\s*@attribute\s"))
        .select(F.col("_metadata.file_path").alias("path"), place.alias("line"))
        .groupBy("path").agg(F.sort_array(F.collect_list("line"))["value"].alias("header"))
        .select("header").distinct().limit(HEADERS + 1).collect()
    )
    if not found:
        raise ValueError(f"no @attribute lines in {path}")
    headers = [[_field(line) for line in r["header"]] for r in found]
    if len(found) > HEADERS or any(h != headers[0] for h in headers):
        raise ValueError(f"the files in {path} have different headers")
    return T.StructType(headers[0])


def _field(line: str) -> T.StructField:
    match = re.match(r"""(?i)\s*@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.+?)\s*$""", line)
    if match is None:
        raise ValueError(f"not an attribute line: {line!r}")
    name, kind = match.groups()
    if name[0] in "'\"":
        name = re.sub(r"\\(.)", r"\1", name[1:-1])
    numeric = kind.split()[0].lower() in NUMERIC
    return T.StructField(name, T.DoubleType() if numeric else T.StringType())


def is_data(line: Column) -> Column:
    """Not blank, not a comment, not a declaration."""
    return strip(line).rlike(r"^[^%@]")


def read_arff(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The data rows as a table: numbers as double, all else as text, ``?`` as NULL.

    The header is read once on the driver; data lines are parsed where they lie. A line
    that does not fit the header raises.
    """
    schema = schema or arff_schema(spark, path)
    safe = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    options = {
        "quote": "'", "escape": "\\", "mode": "FAILFAST",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    }
    parsed = _lines(spark, path).where(is_data(F.col("value"))).select(
        F.from_csv(strip(F.col("value")), safe.simpleString()[7:-1].replace(":", " "), options).alias("r")
    )
    cells = []
    for i, f in enumerate(schema.fields):
        cell = F.col(f"r.c{i}")
        cells.append(F.when(cell != "?", cell).cast(f.dataType).alias(f.name))
    return parsed.select(*cells)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comment lines as (path, line_no, comment); ``line_no`` orders them within a file."""
    marked = _lines(spark, path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        ).alias("line_no"),
    )
    return marked.where(F.startswith(strip(F.col("value")), F.lit("%"))).select(
        "path", "line_no", strip(F.regexp_replace("value", "^%+", "")).alias("comment")
    )


def comments_text(spark: SparkSession, path: str) -> str:
    """All comments of one file in order, one per line: a header, so small."""
    rows = read_comments(spark, path).orderBy("path", "line_no.block", "line_no.at").collect()
    return "\n".join(r["comment"] for r in rows)
