"""Allowed-value validation and tokenizer-config checks.

Both return tables of findings instead of exiting, so a whole batch of
configurations is validated in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibspark.functions.hashing import h48

# ---- fixed values: accepted names ------------------------------------------
CALIBRATION_RECIPES = ["pajama", "github_code", "code_technical_language"]
CLEANING_LANGUAGES = ["java", "py"]
# calibration recipe behind a quantization label suffix
RECIPE_OF_SUFFIX = {"-rnd": "pajama", "-mixed": "code_technical_language", "-code": "github_code"}


def validate_in(df: DataFrame, col: str, allowed: list[str], field: str | None = None) -> DataFrame:
    """The values of ``col`` with their rows and a ``valid`` flag."""
    return (df.groupBy(F.lit(field or col).alias("field"), F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("valid", F.col("value").isin(*allowed)))


def recipe_of(quantization: Column) -> Column:
    expr = F.lit("none")
    for suffix, recipe in reversed(list(RECIPE_OF_SUFFIX.items())):
        expr = F.when(quantization.endswith(suffix), F.lit(recipe)).otherwise(expr)
    return expr


def validate_names(attempts: DataFrame) -> DataFrame:
    """Languages against the cleaning choices, calibration recipes (from the
    quantization labels) against the accepted recipe names."""
    lang = validate_in(attempts, "language", CLEANING_LANGUAGES)
    rec = validate_in(attempts.select(recipe_of(F.col("quantization")).alias("recipe")), "recipe",
                      CALIBRATION_RECIPES)
    return lang.unionByName(rec)


def tokenizer_configs(attempts: DataFrame) -> DataFrame:
    """One tokenizer configuration per model seen in the data (pad id missing
    for one family, to exercise the fallback)."""
    m = attempts.groupBy("model").agg(F.count(F.lit(1)).alias("n_attempts"))
    h = h48(F.col("model"))
    return m.select("model", "n_attempts",
                    F.when(F.col("model").startswith("codellama"), F.lit(None)).otherwise(h % 7).alias("pad_id"),
                    (F.lit(2) + h % 5).alias("eos_id"),
                    F.array(*[F.lit(i) for i in range(7)]).cast("array<bigint>").alias("specials"))


def tokenizer_checks(cfg: DataFrame) -> DataFrame:
    """F24 pad falls back to eos; F25 special-id sanity flags."""
    pad = F.coalesce(F.col("pad_id"), F.col("eos_id")).cast("bigint")
    return cfg.select("model", "n_attempts", pad.alias("pad_id"), F.col("eos_id").cast("bigint").alias("eos_id"),
                      (F.size("specials") >= 1).alias("has_specials"),
                      F.array_contains("specials", pad).alias("pad_is_special"),
                      F.array_contains("specials", F.col("eos_id")).alias("eos_is_special"))
