"""Clean-completions job (X7): completion files -> cleaned completion files.

Each file is one JSON object.  It is parsed as a map of variants, so every
field keeps its value and type; only ``completions`` is replaced.  One read, no
shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.operators.completions import clean_array, language_name
from calibspark.sources.files import read_completion_objects, write_completion_objects, write_object_tree


def clean_completion_files(spark: SparkSession, root: str, language: str = "py") -> DataFrame:
    """S6 -> X6 + F26 + X2 + A5 in place (P14): (rel_path, name, prompt,
    completions, object), ``object`` the whole cleaned object as JSON text.
    Files with equal names in different folders stay apart; an object without
    completions stays as it is."""
    df = read_completion_objects(spark, root)
    lang = language_name(F.lit(language))
    rows = df.select("rel_path", "fields",
                     F.try_variant_get(F.col("fields")["name"], "$", "string").alias("name"),
                     F.try_variant_get(F.col("fields")["prompt"], "$", "string").alias("prompt"),
                     F.try_variant_get(F.col("fields")["completions"], "$", "array<string>").alias("raw"))
    rows = rows.withColumn("completions", clean_array(F.coalesce("prompt", F.lit("")), F.col("raw"), lang))
    replaced = F.transform_values("fields", lambda k, v: F.when(
        (k == "completions") & F.col("completions").isNotNull(), F.to_variant_object("completions")).otherwise(v))
    return rows.select("rel_path", "name", "prompt", "completions", F.to_json(replaced).alias("object"))


def clean_job(spark: SparkSession, root: str, out: str, language: str = "py") -> None:
    """X7 end to end; output as gzipped JSON lines partitioned by run folder."""
    res = clean_completion_files(spark, root, language)
    write_completion_objects(res.withColumn("run", F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)), out, ["run"])


def write_completion_tree(completions: DataFrame, root: str) -> None:
    """Lay down (item_id, attempt, language, prompt, completion) rows as one
    completion file per problem, in two run folders, with a result-file decoy.
    The objects hold further fields; every fifth problem has no completions."""
    per = completions.groupBy("item_id", "prompt", "language").agg(
        F.array_sort(F.collect_list(F.struct("attempt", "completion"))).alias("cs"))
    name = F.concat(F.lit("P_"), F.col("item_id").cast("string"))
    folder = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit("runA/")).otherwise(F.lit("runB/")), "language", F.lit("_benchmark/"))
    texts = F.transform("cs", lambda x: x["completion"])
    body = F.to_json(F.struct(name.alias("name"), F.col("prompt").alias("prompt"),
                              F.when(F.col("item_id") % 5 == 4, F.array().cast("array<string>")).otherwise(texts).alias("completions"),
                              F.col("language").alias("language"), F.lit(0.2).alias("temperature"), F.lit(0.95).alias("top_p"),
                              F.lit("assert f(1)").alias("tests"), F.struct(F.lit(1).alias("a"), F.array(F.lit(True)).alias("b")).alias("extra"),
                              F.array(F.lit("\ndef"), F.lit("\nprint")).alias("stop_tokens")))
    files = per.select(F.concat(folder, name, F.lit(".json.gz")).alias("rel"), body.alias("body"))
    decoys = per.select(F.concat(folder, name, F.lit(".results.json.gz")).alias("rel"),
                        F.to_json(F.struct(name.alias("name"), F.array().alias("results"))).alias("body"))
    write_object_tree(files.unionByName(decoys), root, "rel", "body")
