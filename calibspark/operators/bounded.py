"""Size-checked broadcasts and key fetches.

Every broadcast in the library goes through ``broadcast_if_bounded`` with a
row bound derived from parameters (``nsamples``, quota, number of buckets),
never from the data.  Above the bound the join is left to the planner (and
AQE), which shuffles instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 2_000_000   # rows of a narrow key table
MAX_INLINE_KEYS = 1_000          # keys shipped as literals
PUSHED_IN = 10                   # values of one IN list that Spark pushes down one by one


def broadcast_if_bounded(df: DataFrame, bound_rows: int) -> DataFrame:
    return F.broadcast(df) if bound_rows <= MAX_BROADCAST_ROWS else df


def rows_with_keys(big: DataFrame, keys: DataFrame, key: str, bound_rows: int) -> DataFrame:
    """Rows of ``big`` whose ``key`` occurs in ``keys`` (a bounded selection).

    A small selection becomes a literal filter: IN lists of at most
    ``PUSHED_IN`` values joined by OR, since a longer list reaches the Parquet
    scan as its smallest and largest value only.  A larger selection is a semi
    join (broadcast while bounded) behind a range filter.  Same rows either way.
    """
    if bound_rows <= MAX_INLINE_KEYS:
        values = sorted(r[0] for r in keys.select(key).distinct().collect() if r[0] is not None)
        hit = F.lit(False)
        for i in range(0, len(values), PUSHED_IN):
            part = F.col(key).isin(values[i:i + PUSHED_IN])
            hit = part if i == 0 else hit | part
        return big.where(hit)
    lo, hi = keys.agg(F.min(key), F.max(key)).first()
    inside = big.where(F.col(key).between(lo, hi)) if lo is not None else big.limit(0)
    return inside.join(broadcast_if_bounded(keys.select(key).distinct(), bound_rows), key, "left_semi")
