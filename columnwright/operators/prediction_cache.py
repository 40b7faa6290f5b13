"""A cache of predictions that lies in buckets, so that no question shuffles it.

Rows are bucketed by a hash of their pair (prompt, x, y). A question moves its own distinct pairs
to the buckets; the cache is read where it lies, and new rows are appended bucket by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from columnwright.functions.hashing import row_hash
from columnwright.operators.joins import lookup_join
from columnwright.storage import store

PAIR: Sequence[str] = ("prompt", "x", "y")
SCHEMA = "pair string, prompt string, x string, y string, score double, sequence string"
BUCKETS = 512


def _keyed(df: DataFrame) -> DataFrame:
    """With ``pair``: equal for equal (prompt, x, y), missing values included."""
    return df.withColumn("pair", row_hash(PAIR))


@dataclass(frozen=True)
class PredictionCache:
    """A folder with a bucketed table; ``open`` makes or finds it."""

    spark: SparkSession
    table: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int = BUCKETS) -> PredictionCache:
        """The cache in the folder ``path``, which all executors can reach.

        A folder keeps the number of buckets that it began with; another number raises.
        A new session finds what earlier ones added.
        """
        root = path.rstrip("/")
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/buckets-*")
        files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        held = [f.getPath().getName() for f in files.globStatus(pattern) or []]
        if held and held != [f"buckets-{buckets}"]:
            raise ValueError(f"{path} holds {', '.join(sorted(held))}, not {buckets} buckets")
        name = f"predictions_{hashlib.md5(root.encode()).hexdigest()}"
        location = f"{root}/buckets-{buckets}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (pair) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return PredictionCache(spark, name, buckets)

    def rows(self) -> DataFrame:
        """(prompt, x, y, score, sequence) of all cached pairs."""
        return self.spark.table(self.table).drop("pair")

    def _dealt(self, keyed: DataFrame) -> DataFrame:
        """Folded pairs, where Spark would rather move the cache to its more numerous partitions."""
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) > self.buckets:
            return keyed.repartition(self.buckets, "pair")
        return keyed

    def _lacking(self, keyed: DataFrame) -> DataFrame:
        # No anti join: Spark would move it below the repartitioning, and the cache with it.
        held = self.spark.table(self.table).select("pair", F.lit(True).alias("__held"))
        return self._dealt(keyed).join(held, "pair", "left").where("__held IS NULL").drop("__held")

    def missing(self, pairs: DataFrame) -> DataFrame:
        """Distinct (prompt, x, y) of ``pairs`` that are not cached.

        Repeated pairs are folded before they move, so one pair in many rows makes no hot bucket.
        """
        asked = _keyed(pairs.select(*PAIR)).groupBy("pair").agg(*[F.first(c).alias(c) for c in PAIR])
        return self._lacking(asked).select(*PAIR)

    def add(self, new: DataFrame) -> None:
        """Append (prompt, x, y, score, sequence); a cached pair keeps its first score.

        Adding the same rows again, as after a lost driver, adds nothing. Of repeated new pairs
        the least (score, sequence) counts. One driver adds at a time.
        """
        # Stored first: predictions are dear, and what is appended must not depend on the append.
        least = F.min(F.struct("score", "sequence")).alias("least")
        folded = _keyed(new.select(*PAIR, "score", "sequence")).groupBy("pair").agg(
            *[F.first(c).alias(c) for c in PAIR], least
        ).select("pair", *PAIR, "least.*")
        made = store(self._lacking(store(folded, "predicted").df), "added")
        made.df.repartition(self.buckets, "pair").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def collect(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with their cached score and sequence; NULL for those not cached.

        The answers of the distinct pairs are looked up first; joined back to the rows, rows of
        a hot pair are spread.
        """
        asked = _keyed(pairs.select(*PAIR)).select("pair").distinct()
        held = self.spark.table(self.table)
        answers = store(self._dealt(asked).join(held, "pair").select(*PAIR, "score", "sequence"), "answers").df
        return lookup_join(pairs, answers, PAIR)
