"""File sources and sinks.

Completion and result files are gzipped single-object JSON files in nested
folders.  They are read as whole texts over a recursive listing; ``small_files``
lets Spark deal them to tasks by their bytes, with a small allowance for
opening one, so that a task reads a bundle of many.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from calibspark.functions.outcomes import pass_report_name, safe_name
from pyspark.sql.types import (ArrayType, IntegerType, StringType, StructField, StructType)

RESULTS_SCHEMA = StructType([
    StructField("name", StringType()),
    StructField("results", ArrayType(StructType([
        StructField("status", StringType()), StructField("exit_code", IntegerType())]))),
])

def _root_uri(spark: SparkSession, root: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().toString().rstrip("/") + "/"


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def relative_path(spark: SparkSession, root: str, path: str = "_metadata.file_path") -> Column:
    """A file's path (by default the current one's) relative to ``root``;
    scheme and authority are ignored on both sides (``file:/`` vs ``file:///``)."""
    import re
    prefix = re.sub(_SCHEME, "", _root_uri(spark, root))
    full = F.regexp_replace(F.col(path), _SCHEME, "")
    return F.when(full.startswith(prefix), F.substr(full, F.lit(len(prefix) + 1))).otherwise(full)


#: Bytes that opening a file counts for when files are dealt to tasks.
OPEN_COST = 16 << 10


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside deal files to tasks by bytes: bundles of many small files."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def list_objects(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(rel_path, length, modified) of the files below ``root``; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(relative_path(spark, root, "path").alias("rel_path"), "length", F.col("modificationTime").alias("modified"))


def gunzip(content: Column) -> Column:
    """Text of gzipped bytes (Arrow batches; the bytes of many small files are read
    faster as they are than through a text reader for each)."""
    def texts(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: gzip.decompress(b).decode("utf-8"))

    return F.pandas_udf(texts, "string")(content)


def read_results(spark: SparkSession, root: str, modified_since=None) -> DataFrame:
    """Every ``*.results.json.gz`` below ``root``: (rel_path, name, results);
    files last changed before ``modified_since`` aren't opened."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.results.json.gz").load(root))
    if modified_since is not None:
        df = df.where(F.col("modificationTime") >= F.lit(modified_since))
    body = F.from_json(gunzip(F.col("content")), RESULTS_SCHEMA)
    return df.select(relative_path(spark, root, "path").alias("rel_path"), body.alias("o")).select("rel_path", "o.name", "o.results")


def read_completion_objects(spark: SparkSession, root: str) -> DataFrame:
    """S6, every field kept: (rel_path, fields), ``fields`` the object of each
    completion file as ``map<string, variant>``.  No schema, no inference pass."""
    df = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.gz").text(root))
    df = df.where(~F.col("_metadata.file_name").endswith("results.json.gz"))
    return df.select(relative_path(spark, root).alias("rel_path"),
                     F.from_json("value", "map<string, variant>").alias("fields"))


def write_completion_objects(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """One object per line (column ``object``, JSON text with every field
    it was read with), gzipped, partitioned by run."""
    w = df.select("object", *(partition_cols or [])).write.mode("overwrite").option("compression", "gzip")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.text(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results table with header; ``attempt`` is the pairing key of the reports."""
    schema = "model string, quantization string, language string, problem string, attempt int, pass int"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    """Results table as CSV with header (quoted)."""
    (df.select("model", "quantization", "language", "problem", "attempt", "pass")
     .write.mode("overwrite").option("header", True).csv(path))


def write_calibration(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Calibration rows.  CSV gets arrays and maps as JSON text and
    ``\\`` as escape character; JSON and Parquet keep them native."""
    if fmt == "csv":
        cols = [F.to_json(F.col(f.name)).alias(f.name)
                if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
                for f in df.schema.fields]
        df.select(*cols).write.mode("overwrite").option("header", True).option("escape", "\\").csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train / validation sample, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_decoded(df: DataFrame, path: str) -> None:
    """Decoded text per split as JSON lines (not one giant array)."""
    df.select("split", "sample_id", "raw_data").write.mode("overwrite").partitionBy("split").json(path)


def write_report(df: DataFrame, path: str, order_col: str = "report_pos") -> None:
    """A report (bounded by the number of comparisons) as one CSV."""
    df.orderBy(order_col).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_pass_report(df: DataFrame, folder: str, temperature: float = 0.2) -> None:
    """pass@k rows (bounded by configurations and k) as CSV, under the
    report name of each row's language, model and quantization (F16)."""
    label = safe_name(F.concat_ws("-", "model", "quantization"))
    named = df.withColumn("report", pass_report_name(label, F.col("language"), F.lit(temperature)))
    named.repartition("report").write.mode("overwrite").partitionBy("report").option("header", True).csv(folder)


def read_pass_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """S16 back: the rows with the name of their report."""
    return spark.read.schema(f"{schema}, report string").option("header", True).csv(folder)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then move it to its own: readers see all of it or nothing."""
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(draft, target)


def _read_text(spark: SparkSession, path: str) -> str | None:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if path_exists(spark, path) else None


def input_identity(*inputs: DataFrame) -> list:
    """What a cached output depends on: the tables' input files, schemas and plans."""
    return [[sorted(d.inputFiles()), d.schema.json(), d.semanticHash()] for d in inputs]


def reuse_or_build(spark: SparkSession, path: str, build, fmt: str = "parquet", parameters: dict | None = None) -> DataFrame:
    """Read the finished output at ``path`` if it was built with the same
    ``parameters`` (values that JSON can hold), else build and publish it.

    Each build has a folder of its own; a manifest with its name and parameters is moved
    into place once the folder is complete, so a reader sees a whole output, and
    one that is being read stays as it is."""
    manifest, asked = f"{path.rstrip('/')}/manifest.json", json.loads(json.dumps(parameters or {}, sort_keys=True))
    text = _read_text(spark, manifest)
    known = json.loads(text) if text else None
    if known is None or known["parameters"] != asked or known["format"] != fmt:
        known = {"build": f"build-{uuid.uuid4().hex}", "format": fmt, "parameters": asked}
        build().write.format(fmt).save(f"{path.rstrip('/')}/{known['build']}")
        _write_text(spark, manifest, json.dumps(known, sort_keys=True))
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{known['build']}")


def stored_parameters(spark: SparkSession, path: str) -> dict | None:
    """Parameters that the output at ``path`` was built with."""
    text = _read_text(spark, f"{path.rstrip('/')}/manifest.json")
    return json.loads(text)["parameters"] if text else None


# ---------------------------------------------------------------- fixture trees
def _write_json_gz(rows) -> None:
    """Write each row's body as one gzipped file through ``pyarrow.fs``
    (local paths, ``file:``, ``s3://`` and ``hdfs://`` URIs alike)."""
    from pyarrow import fs as pafs
    cache: dict = {}
    for r in rows:
        scheme = r.path.split("://", 1)[0] if "://" in r.path else "file"
        if scheme not in cache:
            cache[scheme] = pafs.FileSystem.from_uri(r.path)[0]
        filesystem = cache[scheme]
        target = pafs.FileSystem.from_uri(r.path)[1] if "://" in r.path else r.path
        filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(target, compression="gzip") as out:
            out.write(r.body.encode("utf-8"))


def write_object_tree(df: DataFrame, root: str, rel_path_col: str, body_col: str) -> None:
    """Write one gzipped JSON object per row at ``root/<rel_path>``.

    Used to lay down input trees in the shape the evaluation tools produce;
    each task writes its own files (rewritten as a whole on retry).
    """
    local_root = root[len("file:"):] if root.startswith("file:") and not root.startswith("file://") else root
    if local_root.startswith("file://"):
        local_root = local_root[len("file://"):]
    (df.select(F.concat(F.lit(local_root.rstrip("/") + "/"), F.col(rel_path_col)).alias("path"),
               F.col(body_col).alias("body"))
     .foreachPartition(_write_json_gz))
