"""Splits, folds, blocks and samples, all as predicates on the row hash.

Each function makes two small jobs over the key columns (see ``HashOrder``) and returns
a lazy DataFrame whose rows are marked or filtered by literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from columnwright.functions.hashing import row_hash
from columnwright.operators.ordering import HashOrder
from columnwright.storage import store


def _starts(n: int, k: int) -> list[int]:
    """Start positions of folds 1..k-1 when the first ``n % k`` folds get one row more."""
    small, extra = divmod(n, k)
    return [i * small + min(i, extra) for i in range(1, k)]


def kfold_column(df: DataFrame, keys: Sequence[str], k: int, seed: object = 42) -> Column:
    order = HashOrder(df, keys, seed)
    if k < 2 or order.total < k:
        raise ValueError(f"cannot make {k} folds of {order.total} rows")
    return order.segment(order.cuts({None: _starts(order.total, k)}))


def kfold(
    df: DataFrame, keys: Sequence[str], k: int, seed: object = 42, name: str = "fold"
) -> DataFrame:
    """Shuffled k-fold: sizes differ by at most one row."""
    return df.withColumn(name, kfold_column(df, keys, k, seed))


def stratified_sizes(counts: Sequence[int], k: int) -> list[list[int]]:
    """Rows of each class per fold: positions of the class-sorted table dealt round robin."""
    sizes, start = [], 0
    for n in counts:
        end = start + n
        upto = lambda x, i: (x + k - 1 - i) // k
        sizes.append([upto(end, i) - upto(start, i) for i in range(k)])
        start = end
    return sizes


def stratified_kfold_column(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    k: int,
    seed: object = 42,
    order: HashOrder | None = None,
) -> Column:
    order = order or HashOrder(df, keys, seed, stratum=label)
    counts = order.counts
    if k < 2 or all(n < k for n in counts.values()):
        raise ValueError(f"cannot make {k} stratified folds: no class has {k} rows")
    positions = {}
    for s, sizes in zip(counts, stratified_sizes(list(counts.values()), k)):
        positions[s] = [sum(sizes[:i]) for i in range(1, k)]
    return order.segment(order.cuts(positions))


def stratified_kfold(
    df: DataFrame, keys: Sequence[str], label: str, k: int, seed: object = 42, name: str = "fold"
) -> DataFrame:
    """Stratified k-fold: within each class, sizes differ by at most one row."""
    return df.withColumn(name, stratified_kfold_column(df, keys, label, k, seed))


def stored_stratified_kfold(
    df: DataFrame, keys: Sequence[str], label: str, k: int, seed: object = 42, name: str = "fold",
    columns: Sequence[str | Column] = ("*",),
) -> DataFrame:
    """The same on a table written with the hashes of its rows, which no pass works out again.

    ``columns`` are the ones to write, the label among them; the keys are needed for the hashes only.
    """
    table = store(df.select(*columns, row_hash(keys, seed).alias("__order")), "hashed").df
    order = HashOrder(table, keys, seed, stratum=label, hashed="__order")
    return table.withColumn(name, stratified_kfold_column(table, keys, label, k, seed, order)).drop("__order")


def repeated_stratified_kfold(
    df: DataFrame, keys: Sequence[str], label: str, k: int = 3, repeats: int = 1, seed: int = 42
) -> DataFrame:
    """One copy of each row per repeat, with ``repeat`` and ``fold``; each repeat has its own seed."""
    folds = [stratified_kfold_column(df, keys, label, k, seed + r) for r in range(repeats)]
    marks = F.array(*[F.struct(F.lit(r).alias("repeat"), f.alias("fold")) for r, f in enumerate(folds)])
    return df.select("*", F.inline(marks))


def train_quotas(counts: Sequence[int], test_size: float) -> list[int]:
    """Training rows per class: shares of the training size, largest remainders first."""
    n = sum(counts)
    n_train = n - math.ceil(test_size * n)
    quotas = [c * n_train // n for c in counts]
    by_remainder = sorted(range(len(counts)), key=lambda i: (-(counts[i] * n_train % n), i))
    for i in by_remainder[: n_train - sum(quotas)]:
        quotas[i] += 1
    return quotas


def split_stratified(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    test_size: float = 0.2,
    seed: object = 42,
    name: str = "is_test",
) -> DataFrame:
    """Mark the holdout rows; each class is represented by its share."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    order = HashOrder(df, keys, seed, stratum=label)
    counts = order.counts
    quotas = train_quotas(list(counts.values()), test_size)
    cuts = order.cuts({s: [q] for s, q in zip(counts, quotas)})
    return df.withColumn(name, order.segment(cuts) == 1)


def training_folds(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    k: int,
    test_size: float = 0.2,
    seed: object = 42,
    name: str = "fold",
    keep_holdout: bool = False,
    order: HashOrder | None = None,
) -> tuple[DataFrame, int]:
    """The training part of the stratified split with its shuffled folds 0..k-1, and its size.

    The folds' histogram follows from the split's. Kept holdout rows have a NULL fold.
    """
    order = order or HashOrder(df, keys, seed, stratum=label)
    counts = order.counts
    quotas = dict(zip(counts, train_quotas(list(counts.values()), test_size)))
    cuts = order.cuts({s: [q] for s, q in quotas.items()})
    train = order.head(quotas, cuts)
    if k < 2 or train.total < k:
        raise ValueError(f"cannot make {k} folds of {train.total} rows")
    fold = train.segment(train.cuts({None: _starts(train.total, k)}))
    in_train = order.segment(cuts) == 0
    if keep_holdout:
        return df.withColumn(name, fold + F.when(in_train, F.lit(0))), train.total
    return df.where(in_train).withColumn(name, fold), train.total


def split_random(
    df: DataFrame, keys: Sequence[str], frac: float = 0.8, seed: object = 42, name: str = "is_train"
) -> DataFrame:
    """Mark ``round(frac * n)`` rows; the rest are the exact complement."""
    order = HashOrder(df, keys, seed)
    cuts = order.cuts({None: [round(frac * order.total)]})
    return df.withColumn(name, order.segment(cuts) == 0)


def subsample_n(df: DataFrame, keys: Sequence[str], n: int, seed: object = 42) -> DataFrame:
    """``n`` rows without replacement."""
    order = HashOrder(df, keys, seed)
    if n > order.total:
        raise ValueError(f"cannot take {n} of {order.total} rows without replacement")
    return df.where(order.segment(order.cuts({None: [n]})) == 0)


def subsample_cap(df: DataFrame, keys: Sequence[str], cap: int | None, seed: object = 42) -> DataFrame:
    """At most ``cap`` rows; without a cap, all of them."""
    if cap is None:
        return df
    order = HashOrder(df, keys, seed)
    if cap >= order.total:
        return df
    return df.where(order.segment(order.cuts({None: [cap]})) == 0)


def pop_rows(
    df: DataFrame,
    keys: Sequence[str],
    n: int | None = None,
    frac: float | None = None,
    seed: object = 42,
) -> tuple[DataFrame, DataFrame]:
    """Take rows out of a table: (popped, rest). Exactly one of ``n`` and ``frac``."""
    if (n is None) == (frac is None):
        raise ValueError("give exactly one of n and frac")
    order = HashOrder(df, keys, seed)
    size = n if n is not None else int(order.total * frac)
    if size > order.total:
        raise ValueError(f"cannot pop {size} of {order.total} rows")
    side = order.segment(order.cuts({None: [size]}))
    return df.where(side == 0), df.where(side == 1)


class Blocks:
    """Blocks of ``size`` consecutive rows in hash order, with a current block.

    The rows after the last full block belong to none.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], size: int = 30, seed: int = 42) -> None:
        self.df, self.size, self.seed, self.index = df, size, seed, 0
        self._order = HashOrder(df, keys, seed)

    @property
    def n_blocks(self) -> int:
        return self._order.total // self.size

    def block(self, number: int) -> DataFrame:
        if not 0 <= number < self.n_blocks:
            raise ValueError(f"block {number} of {self.n_blocks}")
        cuts = self._order.cuts({None: [number * self.size, (number + 1) * self.size]})
        return self.df.where(self._order.segment(cuts) == 1)

    def random_block(self) -> DataFrame:
        """The block picked by the seed."""
        return self.block(random_block_number(self.n_blocks, self.seed))

    def current(self) -> DataFrame:
        return self.block(self.index)

    def advance(self) -> None:
        """Go to the next block; after the last comes the first."""
        self.index = self.index + 1 if self.index + 1 < self.n_blocks else 0

    def reset(self) -> None:
        self.index = 0


# Fixed value: Knuth's multiplicative hash constant.
SPREAD = 2654435761


def random_block_number(n_blocks: int, seed: int) -> int:
    return seed * SPREAD % 2**32 % n_blocks


def subsample(
    df: DataFrame,
    keys: Sequence[str],
    strategy: str = "full",
    n: int = 30,
    block: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Rows an evaluation strategy looks at."""
    if strategy in ("full", "evaluated"):
        return df
    if strategy == "subsample":
        return subsample_n(df, keys, n, seed)
    blocks = Blocks(df, keys, n, seed)
    if strategy == "random_block":
        return blocks.random_block()
    if strategy == "sequential_block":
        return blocks.block(block % blocks.n_blocks)
    raise ValueError(f"unknown subsampling strategy: {strategy!r}")


def sample_row(df: DataFrame, keys: Sequence[str], seed: object = 42) -> DataFrame:
    """One row, the same for the same seed."""
    order = HashOrder(df, keys, seed)
    return df.where(order.segment(order.cuts({None: [1]})) == 0)
