"""Seeded, partition-independent pseudo-random numbers.

Randomness is a hash of (seed, draw number, purpose) instead of ``rand()``:
the same inputs give the same sample for any partitioning, any retry and
any cluster size, and an SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h48(x: Column) -> Column:
    """48-bit non-negative hash: the first 12 hex digits of md5 as BIGINT."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 12), 16, 10).cast("bigint")


def hkey(*parts) -> Column:
    """``concat_ws('|', parts...)`` with every part cast to string."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform_int(bound: Column, *parts) -> Column:
    """Deterministic integer in ``[0, bound)`` keyed by ``parts``."""
    return F.pmod(h48(hkey(*parts)), bound.cast("bigint"))
