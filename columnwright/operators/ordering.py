"""Positions in a total order without moving the table through one task."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Mapping, Sequence
from copy import copy
from functools import reduce
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.feature import Bucketizer

from columnwright.functions.hashing import row_hash
from columnwright.functions.missing import finite
from columnwright.storage import scratch, store

# Rows that one task may rank.
SMALL_ROWS = 1_000_000
# Hex digits per histogram level, and digits that surely tell rows apart.
DIGITS, MAX_DIGITS = 3, 30
# Ranges of a running total; their offsets are broadcast.
MAX_RANGES = 20_000


class HashOrder:
    """The rows of a table in seeded hash order, per stratum if one is named.

    Row positions are never attached. A histogram over the first hex digits of the row
    hash (keys are unique, so it is even by construction) tells which prefix holds a
    wanted position; a prefix with many rows is counted again by its next digits, and
    only the rows of the prefixes found in the end are ranked. What comes out are *cuts*:
    hash values that mark positions. Folds, splits, blocks and samples are then
    comparisons of the row's own hash with a few literals: no shuffle of the table.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], seed: object, stratum: str | None = None,
        hashed: str | None = None,
    ) -> None:
        self.keys, self.seed, self.stratum, self.hashed = list(keys), seed, stratum, hashed
        self._rows = df.select(
            self.column().alias("h"),
            (F.lit(None).cast("string") if stratum is None else F.col(stratum)).alias("s"),
        )
        self._histogram = self._count(self._rows, DIGITS)

    @staticmethod
    def _count(rows: DataFrame, digits: int) -> dict[object, list[tuple[str, int]]]:
        counted = rows.groupBy("s", F.substring("h", 1, digits).alias("p")).agg(
            F.count(F.lit(1)).alias("n")
        )
        found: dict[object, list[tuple[str, int]]] = {}
        for s, p, n in sorted(counted.collect(), key=lambda r: r[1]):
            found.setdefault(s, []).append((p, n))
        return found

    @property
    def counts(self) -> dict[object, int]:
        """Rows per stratum, strata in sorted order (missing last)."""
        order = sorted(self._histogram, key=lambda s: (s is None, s))
        return {s: sum(n for _, n in self._histogram[s]) for s in order}

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def column(self) -> Column:
        """The row's hash; ``hashed`` names a column of the table that holds it already."""
        return row_hash(self.keys, self.seed) if self.hashed is None else F.col(self.hashed)

    def _place(self, stratum: object, position: int) -> tuple[str, int, int] | None:
        """(prefix, rows with that prefix, rank among them) of a position."""
        spans = self._histogram.get(stratum, [])
        ends = list(accumulate(n for _, n in spans))
        i = bisect_right(ends, position)
        if i == len(ends):
            return None
        prefix, n = spans[i]
        return prefix, n, position - (ends[i] - n) + 1

    def _within(self, prefixes: Iterable[str]) -> DataFrame:
        """The rows whose hash starts with one of the prefixes, marked with it as ``p``."""
        by_length: dict[int, list[str]] = {}
        for p in sorted(set(prefixes)):
            by_length.setdefault(len(p), []).append(p)
        marks = [
            F.when(F.substring("h", 1, n).isin(ps), F.substring("h", 1, n))
            for n, ps in sorted(by_length.items())
        ]
        return self._rows.withColumn("p", F.coalesce(*marks)).where("p IS NOT NULL")

    def _refine(self, positions: Mapping[object, Sequence[int]], rank_rows: int) -> None:
        """Split prefixes that hold a wanted position and more rows than one task should rank."""
        while True:
            places = [(s, self._place(s, at)) for s, spots in positions.items() for at in spots]
            big = {(s, p[0]) for s, p in places if p is not None and p[1] > rank_rows}
            if any(len(p) >= MAX_DIGITS for _, p in big):
                raise ValueError(f"key columns {self.keys} do not identify rows: over {rank_rows} share a hash")
            if not big:
                return
            digits = min(len(p) for _, p in big)
            level = {(s, p) for s, p in big if len(p) == digits}
            finer = self._count(self._within(p for _, p in level), digits + DIGITS)
            for s, prefix in level:
                inside = [(p, n) for p, n in finer[s] if p.startswith(prefix)]
                others = [x for x in self._histogram[s] if x[0] != prefix]
                self._histogram[s] = sorted(others + inside)

    def cuts(
        self, positions: Mapping[object, Sequence[int]], rank_rows: int = SMALL_ROWS
    ) -> dict[object, list[str]]:
        """For each stratum, the hash of the row at each wanted 0-based position.

        A position at or past the end gives ``"g"``, which is above every hash. A cut
        between rows with equal keys cannot be made and raises.
        """
        self._refine(positions, rank_rows)
        places = {s: [self._place(s, at) for at in spots] for s, spots in positions.items()}
        wanted: dict[tuple[object, str], set[int]] = {}
        for s, spots in places.items():
            for spot in spots:
                if spot is not None:
                    wanted.setdefault((s, spot[0]), set()).add(spot[2])
        values: dict[tuple[object, str, int], str] = {}
        if wanted:
            order = Window.partitionBy("s", "p").orderBy("h")
            ranked = self._within(p for _, p in wanted).withColumns(
                {"r": F.row_number().over(order), "twin": F.lag("h").over(order) == F.col("h")}
            ).where(
                reduce(
                    lambda a, b: a | b,
                    [
                        F.col("s").eqNullSafe(F.lit(s)) & (F.col("p") == p)
                        & F.col("r").isin(sorted(ranks))
                        for (s, p), ranks in wanted.items()
                    ],
                )
            )
            for r in ranked.collect():
                if r["twin"]:
                    raise ValueError(f"key columns {self.keys} do not identify rows: a cut falls between equal keys")
                values[r["s"], r["p"], r["r"]] = r["h"]
        return {
            s: ["g" if spot is None else values[(s, spot[0], spot[2])] for spot in spots]
            for s, spots in places.items()
        }

    def head(self, positions: Mapping[object, int], cuts: Mapping[object, Sequence[str]]) -> HashOrder:
        """The order of the rows before one cut per stratum, all strata together.

        Their histogram follows from this one, without another pass.
        """
        out = copy(self)
        out.stratum = None
        out._rows = self._rows.where(_count_marks(F.col("h"), F.col("s"), cuts) == 0).withColumn(
            "s", F.lit(None).cast("string")
        )
        merged: dict[str, int] = {}
        for s, spans in self._histogram.items():
            left = positions.get(s, 0)
            for prefix, n in spans:
                if left <= 0:
                    break
                # A refined prefix is folded back, so that strata share their prefixes.
                short = prefix[:DIGITS]
                merged[short] = merged.get(short, 0) + min(n, left)
                left -= n
        out._histogram = {None: sorted(merged.items())}
        return out

    def segment(self, cuts: Mapping[object, Sequence[str]]) -> Column:
        """How many of the (ascending) cuts lie at or below the row's hash."""
        stratum = F.lit(None).cast("string") if self.stratum is None else F.col(self.stratum)
        return _count_marks(self.column(), stratum, cuts)


def _count_marks(h: Column, stratum: Column, cuts: Mapping[object, Sequence[str]]) -> Column:
    """Sum of comparisons that all take the same hash, so that it is worked out once per row."""
    width = max((len(marks) for marks in cuts.values()), default=0)
    total = F.lit(0)
    for i in range(width):
        at = {s: marks[i] if i < len(marks) else "g" for s, marks in cuts.items()}
        if list(at) == [None]:
            mark = F.lit(at[None])
        else:
            mark = reduce(
                lambda chain, s: chain.when(stratum.eqNullSafe(F.lit(s)), F.lit(at[s])), at, F
            ).otherwise(F.lit("g"))
        total = total + (h >= mark).cast("int")
    return total


def require_unique_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if two rows share their key values."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key columns {list(keys)} do not identify rows: {repeated[0]}")


def running_totals(
    df: DataFrame, order: str, weight: str, total: str, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Add the running sum of ``weight`` up to and including each row.

    ``df`` should be stored; ``order`` must be unique. A table of at most ``small_rows``
    rows takes one window. A bigger one is range-partitioned and written with its range
    number; each range is summed by its own task, on top of the ranges before it.
    """
    n = df.count()
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if n <= small_rows:
        return df.withColumn(total, F.sum(weight).over(upto(Window.orderBy(order))))
    ranges = min(-(-n // small_rows) * 2, MAX_RANGES)
    ranged = store(
        df.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()),
        "ranges",
    ).df
    sums = ranged.groupBy("__range").agg(F.sum(weight).alias("__sum"))
    offsets = sums.select(
        "__range",
        (F.sum("__sum").over(upto(Window.orderBy("__range"))) - F.col("__sum")).alias("__before"),
    )
    within = F.sum(weight).over(upto(Window.partitionBy("__range").orderBy(order)))
    return (
        ranged.withColumn(total, within)
        .join(F.broadcast(offsets), "__range")
        .withColumn(total, F.col(total) + F.col("__before"))
        .drop("__range", "__before")
    )


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], leaf_rows: int = SMALL_ROWS
) -> list[float]:
    """Exact quantiles with linear interpolation, by narrowing value ranges.

    Each pass counts rows between cut values (a sketch proposes the cuts; only counts are
    shuffled) and splits the ranges that hold a wanted rank, until such a range has at most
    ``leaf_rows`` rows or three passes are done; then the distinct values of just those
    ranges are ranked. A value with very many rows is one distinct value.
    """
    values = df.select(finite(F.col(column).cast("double")).alias("v")).where("v IS NOT NULL")
    grid = [i / 256 for i in range(1, 256)]
    first = values.agg(F.count("v").alias("n"), F.percentile_approx("v", grid, 10_000).alias("q"))
    head = first.first()
    n = head["n"]
    if n == 0:
        return [None] * len(probabilities)
    ranks = sorted({f(p * (n - 1)) for p in probabilities for f in (_floor, _ceil)})
    cuts = sorted(set(head["q"]))
    for passes_left in (2, 1, 0):
        counts = _bucket_counts(values, cuts)
        ends = list(accumulate(counts))
        targets = sorted({bisect_right(ends, r) for r in ranks})
        big = [b for b in targets if counts[b] > leaf_rows]
        if not big or not passes_left:
            break
        finer = (
            _bucketed(values, cuts).where(F.col("b").isin(big)).groupBy("b")
            .agg(F.percentile_approx("v", grid, 10_000).alias("q")).collect()
        )
        wider = sorted(set(cuts).union(*[r["q"] for r in finer]))
        if wider == cuts:
            break
        cuts = wider
    by_value = (
        _bucketed(values, cuts).where(F.col("b").isin(targets)).groupBy("b", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("b").orderBy("v")
    spans = by_value.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
    hits = None
    for r in ranks:
        b = bisect_right(ends, r)
        local = r - (ends[b - 1] if b else 0)
        hit = (F.col("b") == b) & (F.col("lo") <= local) & (F.col("hi") > local)
        hits = hit if hits is None else hits | hit
    found: dict[int, float] = {}
    for row in spans.where(hits).collect():
        base = ends[row["b"] - 1] if row["b"] else 0
        for r in ranks:
            if base + row["lo"] <= r < base + row["hi"]:
                found[r] = row["v"]
    out = []
    for p in probabilities:
        at = p * (n - 1)
        low, high = found[_floor(at)], found[_ceil(at)]
        out.append(low + (high - low) * (at - _floor(at)))
    return out


def discrete_quantiles(
    values: DataFrame, steps: int, leaf_rows: int = SMALL_ROWS, n: int | None = None
) -> list[list[float]]:
    """For each column of doubles, the least values that 1/steps, 2/steps, .. of its values
    do not exceed; an empty list for a column without values.

    All columns go through the same passes. Values of a small table are ranked at once. Else
    they are written once, a sketch per column proposes cuts, the values between cuts are counted (only counts are
    shuffled), ranges that hold a wanted rank are split until they have at most ``leaf_rows``
    values or three passes are done, and the distinct values of just those are ranked.
    """
    names = [f"c{i}" for i in range(len(values.columns))]
    read = values.toDF(*names)
    n = read.count() if n is None else n
    shares = [i / steps for i in range(1, steps)]
    if n * len(names) <= leaf_rows:
        listed = ", ".join(f"{p}D" for p in shares)
        small = read.agg(*[
            F.expr(f"percentile_disc(array({listed})) WITHIN GROUP (ORDER BY {c})").alias(c) for c in names
        ]).first()
        return [list(q or []) for q in small]
    with scratch():
        # The passes read doubles only, whatever it took to make them.
        made = store(read.withColumn("f", F.lit(-1)), "values").df
        return [found[0] for found in _narrowed_quantiles(made, len(names), 0, shares, leaf_rows)]


def fold_quantiles(
    values: DataFrame, fold: str, k: int, steps: int, leaf_rows: int = SMALL_ROWS
) -> list[list[list[float]]]:
    """Per column and fold 0..k-1, what ``discrete_quantiles`` gives for the rows of the other folds.

    All folds share the passes of one: values are counted per (range, fold), and the counts of
    the rows outside a fold are the totals less its own. Rows without a fold are in none.
    """
    columns = [c for c in values.columns if c != fold]
    names = [f"c{i}" for i in range(len(columns))]
    read = values.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("f"))
    with scratch():
        return _narrowed_quantiles(store(read, "values").df, len(names), k, [i / steps for i in range(1, steps)], leaf_rows)


# What a sketch may be off by, as a share of the rows, and the marks it is asked for to split a range.
SKETCH_ERROR = 2e-4
GRID = [i / 64 for i in range(1, 64)]


def _narrowed_quantiles(
    read: DataFrame, columns: int, k: int, shares: Sequence[float], leaf_rows: int
) -> list[list[list[float]]]:
    """Quantiles per column of ``c0``, ``c1``, .. and per fold: of the rows whose ``f`` is another.

    With no folds, one list for all rows. A sketch is asked for the values just below and above
    the wanted shares only; between folds these differ by little.
    """
    outside = range(max(k, 1))
    names = [f"c{i}" for i in range(columns)]
    counted = [F.count(c) for c in names]
    inside = read.groupBy("f").agg(*[x.alias(n) for x, n in zip(counted, names)]).collect()
    total = [sum(r[c] for r in inside) for c in names]
    own = [[sum(r[c] for r in inside if r["f"] == j) if k else 0 for j in outside] for c in names]
    size = [[total[c] - own[c][j] for j in outside] for c in range(columns)]
    ranks = [[[ceil(n * p) - 1 for p in shares] if n else [] for n in sizes] for sizes in size]
    # Folds of random rows differ by a few standard deviations of a rank; others are narrowed down later.
    spread = max([SKETCH_ERROR, *([3 * (k / max(n, 1)) ** 0.5 / 2 for n in total] if k else [])])
    marks = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-spread, spread)})
    sketch = lambda c, at: F.percentile_approx(c, at, 10_000).alias("q")
    heads = read.agg(*[sketch(c, marks) for c in names]).first()
    cuts = [sorted(set(q or [0.0])) for q in heads]
    for passes_left in (2, 1, 0):
        counts = [[[0] * (len(cuts[c]) + 1) for _ in outside] for c in range(columns)]
        whole = [[0] * (len(cuts[c]) + 1) for c in range(columns)]
        values: dict[tuple[int, int], set[float]] = {}
        counted = _columns_bucketed(read, cuts).groupBy("c", "b", "f").agg(F.count(F.lit(1)), F.min("v"), F.max("v"))
        for c, b, f, m, low, high in counted.collect():
            whole[c][b] += m
            values.setdefault((c, b), set()).update((low, high))
            for j in outside:
                if not k or f != j:
                    counts[c][j][b] += m
        ends = [[list(accumulate(x)) for x in counts[c]] for c in range(columns)]
        targets = [sorted({bisect_right(ends[c][j], r) for j in outside for r in ranks[c][j]}) for c in range(columns)]
        # A bucket of one value has nothing to split.
        big = [[b for b in bs if whole[c][b] > leaf_rows and len(values[c, b]) > 1] for c, bs in enumerate(targets)]
        if not any(big) or not passes_left:
            break
        wider = [set(c) for c in cuts]
        for c, _, q in _columns_bucketed(read, cuts, big).groupBy("c", "b").agg(sketch("v", GRID)).collect():
            wider[c].update(q)
        if all(len(w) == len(c) for w, c in zip(wider, cuts)):
            break
        cuts = [sorted(w) for w in wider]
    wanted = [
        (c, b, j, r - (ends[c][j][b - 1] if b else 0), r)
        for c in range(columns) for j in outside for r in sorted(set(ranks[c][j])) for b in [bisect_right(ends[c][j], r)]
    ]
    if not wanted:
        return [[[] for _ in outside] for _ in names]
    spark = read.sparkSession
    by_value = _columns_bucketed(read, cuts, targets).groupBy("c", "b", "v").agg(
        *[F.count_if(F.col("f") != j if k else F.lit(True)).alias(f"n{j}") for j in outside]
    )
    upto = Window.partitionBy("c", "b").orderBy("v")
    spans = by_value.select("c", "b", "v", F.array(*[F.sum(f"n{j}").over(upto) for j in outside]).alias("hi"), F.array(*[f"n{j}" for j in outside]).alias("n"))
    asked = spark.createDataFrame(wanted, "c int, b int, j int, at long, r long")
    hi = F.get("hi", F.col("j"))
    # One row per wanted rank: a bounded list.
    rows = spans.join(F.broadcast(asked), ["c", "b"]).where((hi > F.col("at")) & (hi - F.get("n", F.col("j")) <= F.col("at")))
    found = {(x["c"], x["j"], x["r"]): x["v"] for x in rows.select("c", "j", "r", "v").collect()}
    return [[[found[c, j, r] for r in ranks[c][j]] for j in outside] for c in range(columns)]


def _bucket(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are not above the value, by halving."""
    if not cuts:
        return F.lit(0)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(cuts))


def _columns_bucketed(
    read: DataFrame, cuts: Sequence[Sequence[float]], only: Sequence[Sequence[int]] | None = None
) -> DataFrame:
    """(c, b, v, f): number of the column, bucket by its own cuts, value and fold; of some buckets.

    Every column is a scan of its own, which reads just that column.
    """
    parts = []
    for c, own in enumerate(cuts):
        if only is not None and not only[c]:
            continue
        column = F.col(f"c{c}")
        part = read.where(column.isNotNull()).select(F.lit(c).alias("c"), _bucket(column, own).alias("b"), column.alias("v"), "f")
        parts.append(part if only is None else part.where(F.col("b").isin(list(only[c]))))
    return reduce(lambda x, y: x.unionAll(y), parts)


def _floor(x: float) -> int:
    return int(x // 1)


def _ceil(x: float) -> int:
    return -int(-x // 1)


def _bucketed(values: DataFrame, cuts: Sequence[float]) -> DataFrame:
    splits = [float("-inf"), *cuts, float("inf")]
    marked = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(values)
    return marked.withColumn("b", F.col("b").cast("int"))


def _bucket_counts(values: DataFrame, cuts: Sequence[float]) -> list[int]:
    found = _bucketed(values, cuts).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * (len(cuts) + 1)
    for r in found:
        counts[r["b"]] = r["n"]
    return counts
