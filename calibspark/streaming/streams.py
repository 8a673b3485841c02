"""Incremental operators on Structured Streaming.

Sources are file streams whose files may come in any order.  The selections
keep mergeable state in the shared checkpoint folder: each batch writes what
it adds under its own id with overwrite, so a retried batch rewrites the same
folder, and a restarted query goes on from the state; every ``COMPACT`` batches the
state is written anew as one.  The result is selected from the state, so a
late file changes it to what the batch operator gives on all files.

Where positions come at most ``lateness`` behind the largest one seen, the
selection is final once it is full and lies further back: from then on no
batch is read.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from calibspark.operators.sampling import code_candidates, qa_candidates, quota_select
from calibspark.plans.ingest import ATTEMPTS, compact_results
from calibspark.sources.files import path_exists


def _run(query_builder, checkpoint: str) -> None:
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: Batches after which the state is written anew as one.
COMPACT = 16


class Selection:
    """State of a selection that goes on over batches.

    ``candidates(batch)`` gives a batch's candidate rows, ``merge(rows)`` the ones
    of them that matter (equal to merging in any order), ``select(rows)`` the
    result, and ``full(result)`` its last position once nothing more can be taken, else None."""

    def __init__(self, spark: SparkSession, state_dir: str, schema: str, candidates, merge, select, full, lateness: int | None):
        self.spark, self.dir, self.schema = spark, state_dir.rstrip("/"), schema
        self.candidates, self.merge, self.select, self.full, self.lateness = candidates, merge, select, full, lateness

    def _read(self, kind: str, schema: str) -> DataFrame:
        if path_exists(self.spark, f"{self.dir}/{kind}"):
            return self.spark.read.schema(schema + ", batch long").parquet(f"{self.dir}/{kind}")
        return self.spark.createDataFrame([], schema + ", batch long")

    def rows(self, before: int | None = None) -> DataFrame:
        """Merged rows of the batches (those before one)."""
        whole, added = self._read("whole", self.schema), self._read("added", self.schema)
        if before is not None:
            whole, added = whole.where(F.col("batch") < before), added.where(F.col("batch") < before)
        last = whole.agg(F.max("batch")).first()[0]
        if last is not None:  # a whole state holds the batches up to its own
            added = added.where(F.col("batch") > last).unionByName(whole.where(F.col("batch") == last))
        return self.merge(added.drop("batch"))

    def result(self) -> DataFrame:
        return self.select(self.rows())

    @property
    def done(self) -> bool:
        return path_exists(self.spark, f"{self.dir}/done")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        if self.done:
            return  # the batch isn't read
        self.merge(self.candidates(batch)).write.mode("overwrite").parquet(f"{self.dir}/added/batch={batch_id}")
        if batch_id % COMPACT == COMPACT - 1:
            self.rows(batch_id + 1).write.mode("overwrite").parquet(f"{self.dir}/whole/batch={batch_id}")
        if self.lateness is None:
            return
        batch.agg(F.max("pos").alias("hi")).write.mode("overwrite").parquet(f"{self.dir}/seen/batch={batch_id}")
        hi, last = self._read("seen", "hi long").agg(F.max("hi")).first()[0], self.full(self.result())
        if last is not None and hi is not None and hi - self.lateness > last:
            self.spark.createDataFrame([(last,)], "last long").write.mode("overwrite").parquet(f"{self.dir}/done")

    def run(self, source: DataFrame, checkpoint: str) -> DataFrame:
        """Take in what has come, up to where the selection is final: the
        batches after that are let through unread, and later runs don't start a stream."""
        if not self.done:
            query = (source.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start())
            query.awaitTermination()
        return self.result()


def stream_code_candidates(spark: SparkSession, src: str, schema: StructType | str, seqlen: int,
                           out: str, checkpoint: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stateless filter + token count over a corpus file stream, in any order."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    cands = code_candidates(s, seqlen)
    _run(cands.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return spark.read.parquet(out)


def _source(spark: SparkSession, src: str, schema: StructType | str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)


def stream_quota(spark: SparkSession, src: str, schema: StructType | str, seqlen: int, quota: int, strata: list[str],
                 state_dir: str, checkpoint: str, files_per_trigger: int = 1, lateness: int | None = None) -> DataFrame:
    """Incremental quota sampling; equals the batch selection over the
    files seen, in whatever order they came.

    The state is the smallest position of each repository in each stratum.
    That is enough: a repository that isn't taken while a stratum is open has no
    earlier row in it, so only its first row of each stratum can ever be taken."""
    def merge(rows):
        return rows.groupBy("repo", "language").agg(F.min("pos").alias("pos")).select("pos", "repo", "language")

    def select(rows):
        return quota_select(rows, quota, strata).select("pos", "repo", "language")

    def full(result):
        taken = {r.language: r for r in result.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")).collect()}
        return max(r["last"] for r in taken.values()) if all(s in taken and taken[s].n >= quota for s in strata) else None

    state = Selection(spark, state_dir, "pos long, repo string, language string", lambda b: code_candidates(b, seqlen).select("pos", "repo", "language"),
                      merge, select, full, lateness)
    return state.run(_source(spark, src, schema, files_per_trigger), checkpoint)


def stream_head(spark: SparkSession, src: str, schema: StructType | str, k: int, seqlen: int, state_dir: str, checkpoint: str,
                files_per_trigger: int = 1, lateness: int | None = None) -> DataFrame:
    """First ``k`` eligible Q&A rows, incrementally; the state is the ``k``
    smallest eligible positions seen."""
    def smallest(rows):
        return rows.select("pos").orderBy("pos").limit(k)

    def full(result):
        n, last = result.agg(F.count(F.lit(1)), F.max("pos")).first()
        return last if n >= k > 0 else None

    state = Selection(spark, state_dir, "pos long", lambda b: qa_candidates(b, seqlen), smallest, smallest, full, lateness)
    return state.run(_source(spark, src, schema, files_per_trigger), checkpoint)


def stream_pass_rate(spark: SparkSession, root: str, store: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> DataFrame:
    """T4: result files as they appear -> running pass rate per configuration.

    The files that are new are first taken into ``store``, exactly once and many to a
    task (``plans.ingest.compact_results``); the stream is over the few Parquet files
    there (complete mode: each batch overwrites the result, one row per configuration)."""
    compact_results(spark, root, store)
    s = spark.readStream.schema(ATTEMPTS + ", batch long").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{store}/attempts")
    agg = s.groupBy("model", "quantization", "language").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.sum("pass").cast("long").alias("n_pass"), F.avg(F.col("pass").cast("double")).alias("pass_rate"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    _run(agg.writeStream.outputMode("complete").foreachBatch(on_batch), checkpoint)
    return spark.read.parquet(out)


def write_ordered_files(df: DataFrame, dest: str, order_col: str, n_steps: int, files: int = 4, shuffle_seed: int | None = None) -> None:
    """Lay a table down in ``n_steps`` steps of ``order_col`` order, each of
    ``files`` parquet files written by as many tasks, one step after another (with a
    ``shuffle_seed``, in a random order of the steps): a file stream of ``files``
    files per trigger sees a step per batch."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    if lo is None:
        return
    width = (hi - lo) // n_steps + 1
    steps = list(range(n_steps))
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(steps)
    for i in steps:
        a = lo + i * width
        part = df.where((F.col(order_col) >= a) & (F.col(order_col) < a + width))
        part.repartition(files).write.mode("append").parquet(dest)
