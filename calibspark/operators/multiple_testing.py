"""Benjamini-Hochberg adjustment within families.

p_adj(i) = min(1, min over j with rank >= rank(i) of p(j) * n / rank(j)),
ranks ascending by p inside the family.  Ties get equal adjusted values
whatever their order.

``bh_adjust`` uses one window partition per family -- meant for report
families (a handful of comparisons).  ``bh_adjust_two_level`` has no
family-wide window and is used where families grow with the data (one test
per problem).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_adjust(df: DataFrame, p_col: str = "p_value", family: list[str] | None = None,
              out_col: str = "p_adj", tiebreak: list[str] | None = None) -> DataFrame:
    """Add ``out_col``; ``family=None`` means no adjustment (p_adj = p)."""
    if family is None:
        return df.withColumn(out_col, F.col(p_col))
    order = [F.col(p_col)] + [F.col(c) for c in (tiebreak or [])]
    w_rank = (Window.partitionBy(*family) if family else Window).orderBy(*order)
    w_all = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    w_tail = w_rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (df.withColumn("__rk", F.row_number().over(w_rank))
              .withColumn("__n", F.count(F.lit(1)).over(w_all)))
    scaled = F.col(p_col) * F.col("__n") / F.col("__rk")
    return (ranked.withColumn(out_col, F.least(F.lit(1.0), F.min(scaled).over(w_tail)))
            .drop("__rk", "__n"))


def bh_adjust_two_level(df: DataFrame, p_col: str = "p_value", family: list[str] | None = None,
                        out_col: str = "p_adj", n_buckets: int | None = None) -> DataFrame:
    """BH for families of any size, without a family-wide window.

    Tie-invariant form: with R(p) = number of tests of the family whose
    p-value is <= p, p_adj(p) = min(1, min over distinct p' >= p of
    p' * n / R(p')).  Tests are first reduced to distinct (family, p) with
    counts (ties collapse map-side); R is a two-level running count and the
    suffix minimum a two-level running minimum over ranges of (family, p)
    (a window inside each (family, range), plus a table of one row per
    (family, range)).  One path at every size; equal to ``bh_adjust``
    (checked in tests).
    """
    from calibspark.operators.stream_windows import range_buckets
    from calibspark.session import written

    if family is None:
        return df.withColumn(out_col, F.col(p_col))
    fam = list(family)
    # the tests table feeds the ranges and the final join: compute it once
    df = written(df, "tests")
    d = df.groupBy(*fam, p_col).agg(F.count(F.lit(1)).alias("__c"))
    d = range_buckets(d, [*fam, p_col], "__b", n_buckets)
    # n per family and running count R inside (family, bucket)
    w_in = Window.partitionBy(*fam, "__b").orderBy(p_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__r_in", F.sum("__c").over(w_in))
    tot = d.groupBy(*fam, "__b").agg(F.sum("__c").alias("__tot"))
    w_fam_b = Window.partitionBy(*fam).orderBy("__b")
    tot = (tot.withColumn("__base", F.coalesce(F.sum("__tot").over(
        w_fam_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("__n", F.sum("__tot").over(Window.partitionBy(*fam))))
    # the (family, bucket) tables are small; AQE broadcasts them at run time
    d = d.join(tot.select(*fam, "__b", "__base", "__n"), fam + ["__b"])
    d = d.withColumn("__v", F.col(p_col) * F.col("__n") / (F.col("__base") + F.col("__r_in")))
    # suffix minimum of v: inside the bucket, then over later buckets of the family
    w_suf = Window.partitionBy(*fam, "__b").orderBy(F.col(p_col).desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    d = d.withColumn("__m_in", F.min("__v").over(w_suf))
    mins = d.groupBy(*fam, "__b").agg(F.min("__v").alias("__bm"))
    mins = mins.withColumn("__later", F.min("__bm").over(
        w_fam_b.rowsBetween(1, Window.unboundedFollowing))).select(*fam, "__b", "__later")
    d = d.join(mins, fam + ["__b"])
    adj = F.least(F.lit(1.0), F.least(F.col("__m_in"), F.coalesce(F.col("__later"), F.col("__m_in"))))
    table = d.select(*fam, p_col, adj.alias(out_col))
    return df.join(table, fam + [p_col])
