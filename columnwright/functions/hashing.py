"""Seeded row hashes: the only source of order and randomness in this library.

A hash of the key columns gives the same order on every retry and in every engine,
which ``rand()`` and ``monotonically_increasing_id()`` do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Stands for a missing key value; no other key part can begin with it.
MISSING = "~"


def key_part(key: str) -> Column:
    """A key value with its length before it: parts joined together stay unambiguous."""
    text = F.col(key).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(MISSING))


def row_hash(keys: Sequence[str], *salt: object) -> Column:
    """``md5`` of the key values and the salt (usually a seed), as 32 hex digits.

    Rows with different key values, missing ones included, have different texts.
    """
    parts = [key_part(k) for k in keys] + [F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws("|", *parts))


def hash_uniform(keys: Sequence[str], *salt: object) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of the row hash."""
    digits = F.conv(F.substring(row_hash(keys, *salt), 1, 13), 16, 10)
    return digits.cast("double") / F.lit(float(2**52))
