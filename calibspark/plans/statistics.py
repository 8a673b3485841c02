"""Statistics jobs beyond the study reports: per-problem tests with BH
adjustment, the experiment grid, run labels and result-path dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.functions import outcomes as O
from calibspark.operators.multiple_testing import bh_adjust_two_level
from calibspark.operators.paired import Comparison, paired_contingency
from calibspark.plans.reports import with_test_statistics


def all_vs_base(attempts: DataFrame, base: str = "16bit", first: str = "other") -> list[Comparison]:
    """Comparisons of ``base`` against every other configuration (needs the
    distinct configuration list: one small aggregate)."""
    cfgs = [r[0] for r in attempts.select("quantization").distinct().collect()]
    return [Comparison(base, q, first=first) for q in sorted(cfgs) if q != base]


def contingency_table(attempts: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Cells a, b, c, d per (model, language, comparison)."""
    cont = paired_contingency(attempts, ["problem", "attempt"], ["model", "language"],
                              "quantization", "pass", comparisons)
    return cont.select("model", "language", F.col("base").alias("base_precision"),
                       F.col("other").alias("quant_precision"), "n_pairs", "a", "b", "c", "d")


def per_problem_tests(attempts: DataFrame, base: str, other: str) -> DataFrame:
    """Exact paired test per (model, language, problem) over its attempts,
    BH-adjusted across the problems of each (model, language)."""
    cont = paired_contingency(attempts, ["attempt"], ["model", "language", "problem"],
                              "quantization", "pass", [Comparison(base, other, first="other")])
    rep = with_test_statistics(cont.select("model", "language", "problem", "n_pairs", "b", "c"))
    # a family holds one test per problem, so it grows with the benchmark
    return bh_adjust_two_level(rep, "p_value", ["model", "language"], "p_adj")


def experiment_grid(attempts: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Every (model, language) cell present in the data with each
    comparison (a literal explode, not a join), the outcomes that either side
    has, and whether both have some."""
    sizes = attempts.groupBy("model", "language", "quantization").agg(F.count(F.lit(1)).alias("n"))
    cells = sizes.groupBy("model", "language").agg(F.map_from_entries(F.collect_list(F.struct("quantization", "n"))).alias("sizes"))
    cmp = F.array(*[F.struct(F.lit(c.base).alias("base_precision"), F.lit(c.other).alias("quant_precision"))
                    for c in comparisons])
    n = lambda c: F.coalesce(F.try_element_at("sizes", F.col(c)), F.lit(0))
    return (cells.select("model", "language", "sizes", F.inline(cmp))
            .select("model", "language", "base_precision", "quant_precision", n("base_precision").alias("n_base"),
                    n("quant_precision").alias("n_quant"), ((n("base_precision") > 0) & (n("quant_precision") > 0)).alias("testable")))


def result_paths(attempts: DataFrame, converted_every: int = 3) -> DataFrame:
    """One result-file path per (configuration, problem), in the layout
    ``[converted-]<model>-<quant>/<lang>_benchmark_temperature_0.2_x/<problem>.results.json.gz``;
    every ``converted_every``-th problem id uses the ``converted-`` prefix."""
    files = attempts.select("model", "quantization", "language", "problem").distinct()
    pid = F.regexp_extract("problem", r"(\d+)$", 1).cast("long")
    prefix = F.when(pid % converted_every == 0, F.lit("converted-")).otherwise(F.lit(""))
    run = O.run_dir_label(F.col("language"), F.lit("0.2"), F.lit("x"))
    return files.select(F.concat(prefix, F.col("model"), F.lit("-"), F.col("quantization"), F.lit("/"),
                                 run, F.lit("/"), F.col("problem"), F.lit(".results.json.gz")).alias("rel_path"))


def parse_result_paths(paths: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """model, quantization, language from a path relative to the root."""
    m, q, lng = O.path_dimensions(F.col(path_col))
    return paths.select(path_col, m.alias("model"), q.alias("quantization"), lng.alias("language"))


def run_labels(attempts: DataFrame, temperature: str = "0.2") -> DataFrame:
    """F11-F16 per completion file: hub name -> label, safe name, run folder,
    cleaned folder and pass-report name.  Every other model carries an
    organisation prefix so both label branches are exercised."""
    files = attempts.select("model", "quantization", "language", "problem").distinct()
    hub = F.when(F.col("model").startswith("codellama"), F.concat(F.lit("org/"), F.col("model"))) \
        .otherwise(F.col("model"))
    label = O.model_label(hub)
    run = O.run_dir_label(F.col("language"), F.lit(temperature), label)
    path = F.concat_ws("/", F.lit("out"), O.safe_name(hub), run, F.concat(F.col("problem"), F.lit(".json.gz")))
    return files.select(
        "model", "quantization", "language", "problem", hub.alias("hub_name"), label.alias("label"),
        O.safe_name(hub).alias("safe_name"), run.alias("run_dir"), path.alias("completion_path"),
        O.cleaned_path(path).alias("cleaned_path"),
        O.pass_report_name(label, F.col("language"), F.lit(temperature)).alias("pass_report"))


def label_families(attempts: DataFrame, prefixes: list[str]) -> DataFrame:
    """Attempts and passes of each label that begins with one of
    ``prefixes``, with its parts and the label built from them again."""
    label = F.col("quantization")
    bits = F.regexp_extract(label, r"^(\d+)bit", 1).cast("int")
    recipe = F.regexp_extract(label, r"^\d+bit-(rnd|mixed|code)", 1)
    tuned = label.endswith("-finetuned")
    rows = attempts.select("model", "language", "pass", O.prefix_family(label, prefixes).alias("family"),
                           O.precision_label(bits, recipe, tuned).alias("label")).where(F.col("family") != "")
    return rows.groupBy("family", "label", "model", "language").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.sum("pass").cast("long").alias("n_pass"))
