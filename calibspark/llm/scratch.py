"""Written intermediate tables.

An intermediate that is read more than once, or that ends a long lineage, is
written as Parquet below the shared folder in ``spark.checkpoint.dir`` and read
back: a lost executor then costs the running tasks only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.session import scratch_path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder, unique to this call."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(col: str = "text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none."""
    return F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Spark's own setting: the shuffle files of a write are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` that also frees the shuffle files it took.  ``df`` itself
    must not be run again."""
    return stage_all([df], name)


def stage_all(dfs: list[DataFrame], name: str) -> DataFrame:
    """``stage`` of the rows of tables of the same columns, written one after
    another: the shuffle files of one are gone before those of the next come."""
    spark = dfs[0].sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        path = scratch_folder(spark, name)
        for df in dfs:
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(dfs[0].schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
