"""Custom-order sorting (O1): by position in a literal list, unmatched last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_rank(col: Column, values: list[str]) -> Column:
    """1-based position of ``col`` in ``values``; null when absent."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.nullif(F.array_position(arr, col), F.lit(0))


def sort_keys(spec: list[tuple]) -> list[Column]:
    """Sort columns from a spec of ``('rank', col, values)`` or ``('text', col)``,
    ascending with nulls last (R's ``order`` with ``match``)."""
    keys = []
    for item in spec:
        if item[0] == "rank":
            keys.append(list_rank(F.col(item[1]), item[2]).asc_nulls_last())
        else:
            keys.append(F.col(item[1]).asc_nulls_last())
    return keys


def with_sort_position(df: DataFrame, spec: list[tuple], tiebreak: str,
                       out_col: str = "report_pos") -> DataFrame:
    """Add the 1-based output position under ``spec`` (ties by ``tiebreak``).

    Meant for report-sized frames: the position is a global row number.
    """
    w = Window.orderBy(*sort_keys(spec), F.col(tiebreak).asc())
    return df.withColumn(out_col, F.row_number().over(w))


def custom_sort(df: DataFrame, spec: list[tuple], tiebreak: str | None = None) -> DataFrame:
    """Distributed sort by the custom keys (range-partitioned ``orderBy``)."""
    keys = sort_keys(spec) + ([F.col(tiebreak).asc()] if tiebreak else [])
    return df.orderBy(*keys)
