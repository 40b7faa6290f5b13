"""Writers. Every table is written by the tasks that hold it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = (
    "round int, status string, suggestions string, selected array<string>, "
    "score_before double, score_added double, score_pruned double, accepted boolean"
)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The table with every column ever added, as CSV with a header, or Parquet."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown format: {kind!r}")


def write_folds(df: DataFrame, keys: Sequence[str], path: str, fold: str = "fold") -> None:
    """Row keys, one folder per fold."""
    df.select(*keys, fold).write.partitionBy(fold).parquet(path)


def append_selected(selected: DataFrame, path: str) -> None:
    """Add (split, position, feature) rows."""
    selected.select("split", "position", "feature").write.mode("append").json(path)


def write_selected_split(spark: SparkSession, split: int, features: Sequence[str], path: str) -> None:
    """One split's features as a folder of its own below ``path``.

    Written anew, it takes the place of what the folder held and leaves other splits' folders
    alone, so a split can be reported again after a failure. A split without features has a
    folder without rows.
    """
    rows = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/split={split}")


def read_selected_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, position, feature) of the splits written so far."""
    return spark.read.schema("position int, feature string, split int").json(path).select("split", "position", "feature")


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split int, position int, feature string").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Add ledger rows."""
    rows.write.mode("append").parquet(path)


def ledger_row(spark: SparkSession, row: Mapping[str, object]) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in LEDGER.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def write_arff(df: DataFrame, relation: str, path: str, comments: Sequence[str] = ()) -> None:
    """A folder of ARFF parts: the header in one file, the data in as many as there are tasks."""
    spark = df.sparkSession
    lines = [f"% {c}" for c in comments] + [f"@relation {_quote(relation)}"]
    for f in df.schema.fields:
        numeric = f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
        lines.append(f"@attribute {_quote(f.name)} {'numeric' if numeric else 'string'}")
    lines.append("@data")
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(
        1
    ).sortWithinPartitions("i").select("value").write.text(path)
    cells = []
    for f in df.schema.fields:
        text = F.col(f.name).cast("string")
        if f.dataType.typeName() == "string":
            escaped = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "'", r"\\'")
            broken = F.raise_error(F.lit(f"line break in ARFF column {f.name}"))
            text = F.when(text.rlike("[\\r\\n]"), broken).otherwise(
                F.concat(F.lit("'"), escaped, F.lit("'"))
            )
        cells.append(F.coalesce(text, F.lit("?")))
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode("append").text(path)


def _quote(name: str) -> str:
    return name if name.replace("_", "").isalnum() else "'" + name.replace("'", "\\'") + "'"
