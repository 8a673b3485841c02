"""Result ingest (R1): result files -> attempts table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.functions.outcomes import pass_flag, path_dimensions
from calibspark.operators.bounded import broadcast_if_bounded
from calibspark.session import scratch_path
from calibspark.sources.files import list_objects, path_exists, read_results, small_files, write_object_tree

ATTEMPTS = "model string, quantization string, language string, problem string, attempt int, status string, exit_code int, pass int"
FILES = "rel_path string, length long, modified timestamp"


def attempts_of(results: DataFrame) -> DataFrame:
    """F9/F10 on the relative path -> X5 posexplode -> P11."""
    model, quant, lang = path_dimensions(F.col("rel_path"))
    return results.select(model.alias("model"), quant.alias("quantization"), lang.alias("language"),
                          F.col("name").alias("problem"),
                          F.posexplode("results").alias("attempt", "r")).select(
        "model", "quantization", "language", "problem", F.col("attempt").cast("int").alias("attempt"),
        F.col("r.status").alias("status"), F.col("r.exit_code").alias("exit_code"),
        pass_flag(F.col("r.status"), F.col("r.exit_code")).alias("pass"))


def compact_results(spark: SparkSession, root: str, store: str) -> DataFrame:
    """Take the result files below ``root`` into ``store``, each exactly
    once, and return all attempts there.

    A batch is first noted: the files that no earlier batch has (a listing without
    opening them).  Then it is read, many files to a task by their bytes, and its
    attempts are written to the batch's own folder.  A batch that was noted
    but whose attempts aren't complete is done again from its note, with overwrite."""
    with small_files(spark):
        _compact(spark, root, f"{store}/files", f"{store}/attempts")
    return spark.read.schema(ATTEMPTS + ", batch long").parquet(f"{store}/attempts").drop("batch")


def _compact(spark: SparkSession, root: str, notes: str, rows: str) -> None:
    def noted() -> DataFrame:
        return spark.read.schema(FILES + ", batch long").parquet(notes)

    last = noted().agg(F.max("batch")).first()[0] if path_exists(spark, notes) else None
    if last is None or path_exists(spark, f"{rows}/batch={last}/_SUCCESS"):
        new = list_objects(spark, root, "*.results.json.gz")
        if last is not None:
            new = new.join(noted().select("rel_path"), "rel_path", "left_anti")
        batch = 0 if last is None else last + 1
        if last is None or not new.isEmpty():
            new.write.parquet(f"{notes}/batch={batch}")
            last = batch
    if not path_exists(spark, f"{rows}/batch={last}/_SUCCESS"):
        files = spark.read.schema(FILES).parquet(f"{notes}/batch={last}")
        n, since = files.agg(F.count(F.lit(1)), F.min("modified")).first()
        results = read_results(spark, root, since).join(broadcast_if_bounded(files.select("rel_path"), n), "rel_path", "left_semi")
        attempts_of(results).write.mode("overwrite").parquet(f"{rows}/batch={last}")


def ingest_results(spark: SparkSession, root: str, store: str | None = None) -> DataFrame:
    """All attempts below ``root``, kept in ``store`` (default: a new folder)."""
    return compact_results(spark, root, store or scratch_path(spark, f"attempts-{uuid.uuid4().hex}"))


def write_result_tree(attempts: DataFrame, root: str, converted_every: int = 3) -> None:
    """Lay down ``attempts`` as result files (FIXTURES view H): one object per
    (configuration, problem) with its results in attempt order, some model
    folders prefixed ``converted-``, plus one plain completion file per
    problem folder that ingest must skip."""
    per = attempts.groupBy("model", "quantization", "language", "problem").agg(
        F.array_sort(F.collect_list(F.struct("attempt", "status", "exit_code"))).alias("rs"))
    pid = F.regexp_extract("problem", r"(\d+)$", 1).cast("long")
    prefix = F.when(pid % converted_every == 0, F.lit("converted-")).otherwise(F.lit(""))
    folder = F.concat(prefix, F.col("model"), F.lit("-"), F.col("quantization"), F.lit("/"),
                      F.col("language"), F.lit("_benchmark_temperature_0.2_x/"))
    body = F.to_json(F.struct(F.col("problem").alias("name"),
                              F.transform("rs", lambda x: F.struct(x["status"].alias("status"),
                                                                    x["exit_code"].alias("exit_code"))
                                          ).alias("results")))
    files = per.select(F.concat(folder, F.col("problem"), F.lit(".results.json.gz")).alias("rel"),
                       body.alias("body"))
    decoys = per.select(F.concat(folder, F.col("problem"), F.lit(".json.gz")).alias("rel"),
                        F.to_json(F.struct(F.col("problem").alias("name"),
                                           F.lit("").alias("prompt"))).alias("body"))
    write_object_tree(files.unionByName(decoys), root, "rel", "body")
