"""Keyed pairing of outcomes and the 2x2 paired contingency.

The reference pairs two outcome vectors by file position.  Here pairs are
formed on an explicit key (model, language, problem, attempt):

  shuffle 1  groupBy(group + key) with a bit for each configuration that has
             an outcome and one for each that passed: two longs for up to 62
             configurations, however many comparisons there are.
  shuffle 2  groupBy(group + bits) counts the keys of each pattern; comparisons
             are evaluated on the distinct patterns only.
  shuffle 3  groupBy(group, comparison) adds up the cells, a few rows.

All comparisons of a report are answered by the same shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparison:
    """Compare configuration ``base`` with ``other``.

    ``first`` says which of the two is the first argument of the test
    ('base' or 'other'); the odds ratio is b / c with b = (first 0, second 1).
    ``family_tag`` adds a label to the multiple-testing family.
    """
    base: str
    other: str
    first: str = "base"
    family_tag: str = ""

    @property
    def first_config(self) -> str:
        return self.base if self.first == "base" else self.other

    @property
    def second_config(self) -> str:
        return self.other if self.first == "base" else self.base


#: Configurations whose bits share a long.
WORD = 62


def outcome_bits(df: DataFrame, key_cols: list[str], group_cols: list[str],
                 config_col: str, outcome_col: str, configs: list[str]) -> DataFrame:
    """One row per pairing key: ``present`` and ``passed``, arrays of longs with
    a bit per configuration.

    A duplicated (key, configuration) raises at run time instead of being
    merged silently.
    """
    number = F.array_position(F.lit(configs), F.col(config_col)) - 1
    rows = df.where(F.col(config_col).isin(configs)).select(
        *group_cols, *key_cols, F.floor(number / WORD).cast("int").alias("__w"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD).cast("int")).alias("__bit"), F.col(outcome_col).alias("__o"))
    words = range(-(-len(configs) // WORD))

    def bits(w: int, on: Column) -> Column:
        return F.coalesce(F.bit_or(F.when((F.col("__w") == w) & on, F.col("__bit"))), F.lit(0).cast("long"))

    keys = rows.groupBy(*group_cols, *key_cols).agg(
        F.count(F.lit(1)).alias("__n"), F.array(*[bits(w, F.col("__o").isNotNull()) for w in words]).alias("present"),
        F.array(*[bits(w, F.col("__o") == 1) for w in words]).alias("passed"))
    # more rows than configurations present <=> a duplicated (key, configuration)
    found = F.aggregate("present", F.lit(0), lambda n, x: n + F.bit_count(x))
    check = F.when(F.col("__n") > found, F.raise_error(F.lit("duplicate outcome for a configuration")))
    return keys.where(check.isNull()).drop("__n")


def paired_contingency(df: DataFrame, key_cols: list[str], group_cols: list[str],
                       config_col: str, outcome_col: str, comparisons: list[Comparison],
                       on_unpaired: str = "error") -> DataFrame:
    """Rows ``group_cols + (cmp_idx, base, other, family_tag, n_pairs, a, b, c, d)``.

    ``on_unpaired``: 'error' fails the job when a key has one side of a
    comparison but not the other; 'drop' ignores such keys.
    """
    configs = sorted({x for cmp in comparisons for x in (cmp.base, cmp.other)})
    keys = outcome_bits(df, key_cols, group_cols, config_col, outcome_col, configs)
    patterns = keys.groupBy(*group_cols, "present", "passed").agg(F.count(F.lit(1)).alias("n"))

    def side(config: str, name: str) -> list[Column]:
        i = configs.index(config)
        return [F.lit(i // WORD).alias(f"{name}_word"), F.lit(1 << (i % WORD)).cast("long").alias(f"{name}_bit")]

    table = F.array(*[F.struct(F.lit(j).alias("cmp_idx"), F.lit(cmp.base).alias("base"), F.lit(cmp.other).alias("other"),
                               F.lit(cmp.family_tag).alias("family_tag"), *side(cmp.first_config, "first"), *side(cmp.second_config, "second"))
                      for j, cmp in enumerate(comparisons)])

    def has(bits: str, name: str) -> Column:
        return F.get(F.col(bits), F.col(f"{name}_word")).bitwiseAND(F.col(f"{name}_bit")) != 0

    rows = patterns.select(*group_cols, "present", "passed", "n", F.inline(table)).select(
        *group_cols, "cmp_idx", "base", "other", "family_tag", "n", has("present", "first").alias("__f"), has("present", "second").alias("__s"),
        has("passed", "first").alias("__x"), has("passed", "second").alias("__y"))
    both, x, y = F.col("__f") & F.col("__s"), F.col("__x"), F.col("__y")

    def keys_with(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    out = rows.groupBy(*group_cols, "cmp_idx", "base", "other", "family_tag").agg(
        keys_with(both).alias("n_pairs"), keys_with(both & ~x & ~y).alias("a"), keys_with(both & ~x & y).alias("b"),
        keys_with(both & x & ~y).alias("c"), keys_with(both & x & y).alias("d"), keys_with(F.col("__f") != F.col("__s")).alias("__u"))
    if on_unpaired == "error":
        message = F.concat(F.lit("unpaired outcomes in comparison "), "base", F.lit(" vs "), "other")
        out = out.withColumn("n_pairs", F.when(F.col("__u") > 0, F.raise_error(message).cast("long")).otherwise(F.col("n_pairs")))
    return out.drop("__u")


def paired_columns(df: DataFrame, first_col: str, second_col: str,
                   group_cols: list[str]) -> DataFrame:
    """Contingency of two 0/1 columns of the same rows (already paired),
    per group: ``group_cols + (n_pairs, a, b, c, d)``."""
    f, s = F.col(first_col), F.col(second_col)

    def cell(fv, sv):
        return F.sum(F.when((f == fv) & (s == sv), 1).otherwise(0)).cast("long")

    both = f.isNotNull() & s.isNotNull()
    return df.groupBy(*group_cols).agg(
        F.sum(F.when(both, 1).otherwise(0)).cast("long").alias("n_pairs"),
        cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"))
