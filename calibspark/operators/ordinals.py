"""Global ordinals without a single-partition window.

The ordinal is the 0-based rank in order-column order: ranges of the column
with a window inside each, plus a table of range bases.  Equal positions fall
into one range, where neighbours are compared; they are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibspark.session import written


def pos_ordinals(df: DataFrame, order_col: str = "pos") -> DataFrame:
    """``df`` with ``ord``, its rank by ``order_col``; written once, so
    that later calls read the ordinals instead of making them again."""
    from calibspark.operators.stream_windows import range_buckets
    ranged = range_buckets(df, [order_col], "__rb")
    inside = Window.partitionBy("__rb").orderBy(order_col)
    bad = F.col(order_col).isNull() | F.coalesce(F.lag(order_col).over(inside).eqNullSafe(F.col(order_col)) & (F.row_number().over(inside) > 1), F.lit(False))
    place = F.when(bad, F.raise_error(F.lit(f"{order_col} must be unique and not null")).cast("long")).otherwise(F.row_number().over(inside) - 1)
    totals = ranged.groupBy("__rb").agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    base = totals.select("__rb", F.coalesce(F.sum("__n").over(Window.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return written(ranged.withColumn("__in", place).join(base, "__rb").withColumn("ord", (F.col("__base") + F.col("__in")).cast("bigint"))
                   .drop("__rb", "__in", "__base"), "ordinals")
