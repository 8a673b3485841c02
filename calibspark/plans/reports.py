"""Paired significance reports.

One plan per report: attempts -> keyed pairing (shuffle 1) -> contingency
of every comparison (shuffle 2, tiny) -> exact p / odds ratio expressions
-> BH within families (tiny window) -> custom sort position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.functions.outcomes import prefix_family
from calibspark.functions.stats import mcnemar_exact_p, or_infinite, paired_odds_ratio
from calibspark.operators.multiple_testing import bh_adjust
from calibspark.operators.ordering import with_sort_position
from calibspark.operators.paired import Comparison, paired_columns, paired_contingency


@dataclass(frozen=True)
class ReportSpec:
    models: list[str]
    languages: list[str]
    comparisons: list[Comparison]          # per (model, language) cell, in insertion order
    family: list[str] | None               # BH family columns; None = no adjustment
    sort: list[tuple] = field(default_factory=list)
    family_prefixes: list[str] = field(default_factory=list)  # family_tag: the prefix of both labels (P16)


# ---- fixed values: the study grids, comparison lists and sort lists --------
_LANGS = ["py", "java"]
_MODELS_7B = ["codellama-7b", "deepseekcoder-7b"]
_SORT_MODELS_7B = ["deepseekcoder-7b", "codellama-7b"]
_BITS = ["8bit", "4bit", "3bit", "2bit"]

RQ1 = ReportSpec(
    models=_MODELS_7B, languages=_LANGS,
    comparisons=[Comparison("16bit", q, first="other") for q in _BITS],
    family=["model", "lng"],
    sort=[("rank", "model", _SORT_MODELS_7B), ("text", "lng"), ("text", "base_precision"),
          ("rank", "quant_precision", ["16bit", "8bit", "4bit", "3bit", "2bit"])],
)

RQ1_FINETUNED = ReportSpec(
    models=_MODELS_7B, languages=_LANGS,
    comparisons=[Comparison(q, q + "-finetuned", first="base") for q in ["3bit", "2bit"]],
    family=None,
    sort=[("rank", "model", _SORT_MODELS_7B), ("text", "lng"), ("text", "base_precision"),
          ("rank", "quant_precision", ["3bit", "2bit"])],
)

RQ2 = ReportSpec(
    models=_MODELS_7B, languages=_LANGS,
    comparisons=[c for q in _BITS for c in (
        Comparison(q + "-rnd", q + "-mixed", first="base"),
        Comparison(q + "-rnd", q + "-code", first="base"),
        Comparison(q + "-mixed", q + "-code", first="base"))],
    family=["model", "lng", "family_tag"], family_prefixes=_BITS,
    sort=[("rank", "model", _SORT_MODELS_7B), ("text", "lng"),
          ("rank", "base_precision", ["8bit-rnd", "8bit-mixed", "8bit-code", "4bit-rnd",
                                      "4bit-mixed", "4bit-code", "3bit-rnd", "3bit-mixed",
                                      "3bit-code", "2bit-rnd", "2bit-mixed", "2bit-code"])],
)

RQ3 = ReportSpec(
    models=["deepseekcoder-1b", "codellama-7b", "deepseekcoder-7b", "codellama-13b",
            "deepseekcoder-33b", "codellama-34b"],
    languages=_LANGS,
    comparisons=[Comparison("16bit", q, first="other") for q in ["2bit-mixed", "2bit-mixed-finetuned"]],
    family=["model", "lng"],
    # the study's sort list names 'deepseekcoder-1_3b' while the data says
    # 'deepseekcoder-1b', so that model sorts last; kept to reproduce it
    sort=[("rank", "model", ["deepseekcoder-1_3b", "codellama-7b", "deepseekcoder-7b",
                             "codellama-13b", "deepseekcoder-33b", "codellama-34b"]),
          ("text", "lng"), ("text", "base_precision"),
          ("rank", "quant_precision", ["16bit", "2bit-mixed", "2bit-mixed-finetuned"])],
)

REPORT_COLUMNS = ["row_id", "base_precision", "quant_precision", "lng", "model", "n_pairs",
                  "b", "c", "p_value", "p_adj", "odds_ratio", "or_infinite", "report_pos"]


def with_test_statistics(df: DataFrame) -> DataFrame:
    """Add p_value, odds_ratio and or_infinite from columns b and c."""
    b, c = F.col("b"), F.col("c")
    return (df.withColumn("p_value", mcnemar_exact_p(b, c))
            .withColumn("odds_ratio", paired_odds_ratio(b, c))
            .withColumn("or_infinite", or_infinite(b, c)))


def paired_report(attempts: DataFrame, spec: ReportSpec, on_unpaired: str = "error",
                  key_cols: tuple[str, ...] = ("problem", "attempt"),
                  config_col: str = "quantization", outcome_col: str = "pass") -> DataFrame:
    """Report rows (``REPORT_COLUMNS``) for one study spec.

    ``row_id`` is the insertion index of the study loop (model, language,
    comparison); ``report_pos`` the position after the study's sort.
    """
    df = attempts.where(F.col("model").isin(spec.models) & F.col("language").isin(spec.languages))
    cont = paired_contingency(df, list(key_cols), ["model", "language"], config_col,
                              outcome_col, spec.comparisons, on_unpaired)
    n_l, n_c = len(spec.languages), len(spec.comparisons)
    m_idx = F.array_position(F.array(*[F.lit(m) for m in spec.models]), F.col("model")) - 1
    l_idx = F.array_position(F.array(*[F.lit(x) for x in spec.languages]), F.col("language")) - 1
    row_id = (m_idx * (n_l * n_c) + l_idx * n_c + F.col("cmp_idx") + 1).cast("int")
    rep = cont.select(row_id.alias("row_id"), F.col("base").alias("base_precision"),
                      F.col("other").alias("quant_precision"), F.col("language").alias("lng"),
                      "model", "family_tag", "n_pairs", "b", "c")
    if spec.family_prefixes:
        rep = rep.withColumn("family_tag", prefix_family(F.col("base_precision"), spec.family_prefixes))
    rep = with_test_statistics(rep)
    rep = bh_adjust(rep, "p_value", spec.family, "p_adj", tiebreak=["row_id"])
    rep = with_sort_position(rep, spec.sort, "row_id")
    return rep.select(*REPORT_COLUMNS)


def column_pair_report(df: DataFrame, first_col: str, second_col: str, group_cols: list[str],
                       family: list[str] | None = None) -> DataFrame:
    """Generic paired report (R6) on two 0/1 columns of already-paired rows."""
    rep = with_test_statistics(paired_columns(df, first_col, second_col, group_cols))
    return bh_adjust(rep, "p_value", family, "p_adj", tiebreak=group_cols)
