"""Per-problem counts, pass@k and pass rates.

Two-level aggregation: (configuration, problem) then configuration.  Both
aggregates are partial on the map side, so a hot configuration never lands
on one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.functions.stats import pass_at_k

CONFIG = ["model", "quantization", "language"]


def problem_counts(attempts: DataFrame, config: list[str] = CONFIG,
                   outcome_col: str = "pass") -> DataFrame:
    """``config + problem + (n, c)``: attempts and passes per problem."""
    return attempts.groupBy(*config, "problem").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.sum(F.col(outcome_col)).cast("int").alias("c"))


def pass_at_k_table(attempts: DataFrame, ks: list[int], config: list[str] = CONFIG,
                    outcome_col: str = "pass") -> DataFrame:
    """One row per (configuration, k): mean unbiased pass@k over problems with
    the number of problems and the min / max completions per problem.  A k is
    reported only when every problem has at least k completions."""
    per_problem = problem_counts(attempts, config, outcome_col)
    est = [pass_at_k(F.col("n"), F.col("c"), k).alias(f"e{k}") for k in ks]
    per_cfg = per_problem.select(*config, "n", *est).groupBy(*config).agg(
        F.count(F.lit(1)).alias("num_problems"),
        F.min("n").alias("min_completions"), F.max("n").alias("max_completions"),
        *[F.avg(f"e{k}").alias(f"p{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pass_at_k")) for k in ks])
    return (per_cfg.select(*config, "num_problems", "min_completions", "max_completions",
                           F.inline(rows))
            .where(F.col("min_completions") >= F.col("k")))


def pass_rate(attempts: DataFrame, config: list[str] = CONFIG,
              outcome_col: str = "pass") -> DataFrame:
    """Simple accuracy per configuration."""
    return attempts.groupBy(*config).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.sum(F.col(outcome_col)).cast("long").alias("n_pass"),
        F.avg(F.col(outcome_col).cast("double")).alias("pass_rate"))


def cap_attempts(df: DataFrame, n: int, attempt_col: str = "attempt") -> DataFrame:
    """Keep the first ``n`` completions of every problem (W8).  ``attempt`` is a
    dense 0-based position (from ``posexplode``), so this is a plain filter."""
    return df.where(F.col(attempt_col) < n)
