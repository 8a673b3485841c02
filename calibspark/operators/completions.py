"""Completion cleaning operators (X2-X7, A5, F17-F23 applied to tables).

Cleaning maps the per-problem array in place.  Where one row per attempt is
wanted, ``posexplode`` (X6) and the regrouping in attempt order (A5) do it; a
problem holds a bounded number of completions (the sampling budget).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibspark.functions.code import cut_first_function, split_doc, strip_comments  # noqa: F401

LANGUAGE_NAMES = {"java": "java", "py": "python"}  # fixed values: CLI language codes


def explode_completions(df: DataFrame, array_col: str = "completions") -> DataFrame:
    """One row per completion with its 0-based ``attempt``; a problem
    without completions keeps one row with null attempt and completion."""
    others = [c for c in df.columns if c != array_col]
    return df.select(*others, F.posexplode_outer(array_col).alias("attempt", "completion"))


def regroup_completions(df: DataFrame, keys: list[str], attempt_col: str = "attempt",
                        text_col: str = "completion") -> DataFrame:
    """A5: rebuild the per-problem array in attempt order (empty for a null attempt)."""
    parts = F.array_sort(F.collect_list(F.when(F.col(attempt_col).isNotNull(), F.struct(attempt_col, text_col))))
    return df.groupBy(*keys).agg(F.transform(parts, lambda x: x[text_col]).alias("completions"))


def language_name(code: Column) -> Column:
    """CLI language code -> lexer language (java -> java, py -> python)."""
    m = F.create_map(*[x for k, v in LANGUAGE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, code)


def clean_array(prompt: Column, completions: Column, language: Column) -> Column:
    """X7 core: every completion of the array cut in place (an empty array stays)."""
    return F.transform(completions, lambda c: cut_first_function(prompt, c, language))
