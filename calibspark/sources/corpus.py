"""Corpus scans (S1-S4): any table with an order column and a text column
becomes ``(pos, text, meta)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.operators.bounded import broadcast_if_bounded
from calibspark.sources.tables import table


def read_corpus(spark: SparkSession, path: str, text_col: str = "text", pos_col: str | None = "pos",
                meta_col: str | None = "meta", fmt: str = "parquet", subset: str | None = None,
                subset_col: str = "subset", split: str | None = None,
                split_col: str = "split", schema=None) -> DataFrame:
    """Scan a corpus; ``subset`` / ``split`` become pushed-down filters
    (partition pruning when the data is laid out by them).  Gzipped JSON-lines
    shards are read with ``fmt='json'`` (one task per unsplittable shard);
    text formats need a ``schema``, since inferring one reads the whole corpus.

    ``pos_col=None``: the corpus has no order column; ``pos`` is the arrival
    ordinal over all rows in the order of file names and of places in the files
    (see ``with_arrival``)."""
    if schema is None and fmt in ("json", "csv"):
        raise ValueError(f"{fmt} corpora need a schema")
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if pos_col is None:
        df, pos_col = with_arrival(df, text_col, fmt), "__pos"
    if subset is not None:
        df = df.where(F.col(subset_col) == subset)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    meta = F.col(meta_col).cast("string") if meta_col else F.lit(None).cast("string")
    return df.select(F.col(pos_col).cast("long").alias("pos"), F.col(text_col).alias("text"),
                     meta.alias("meta"))


def with_arrival(df: DataFrame, text_col: str, fmt: str) -> DataFrame:
    """Add ``__pos``, the 0-based arrival ordinal, to a scan.

    One pass counts the rows of each file block (one row per block, of which the
    prefix sum is taken); an ordinal is its block's base plus the row's place.
    The place is Parquet's own row index in the file, and for text formats the
    row's number in its scan task less that of the block's first row.  Rows are
    neither shuffled nor written.  A scan whose blocks are dealt to tasks in
    another way than in the counting pass fails."""
    if fmt == "parquet":
        keys, place = ["__file"], F.col("_metadata.row_index")
    else:
        keys, place = ["__file", "__block", "__task"], F.monotonically_increasing_id()
    made = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                     place.alias("__at")).withColumn("__task", F.shiftright("__at", 33))
    # the longest text is asked for so that the text is parsed as in the later scan
    counted = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"), F.max(F.length(text_col)))
    order = ["__file"] if fmt == "parquet" else ["__file", "__block"]
    blocks = counted.select(*keys, "__first", "n").orderBy(*order).collect()  # one row per file block
    base, rows = 0, []
    for r in blocks:
        rows.append((*[r[k] for k in keys], base - r["__first"]))
        base += r.n
    bases = df.sparkSession.createDataFrame(rows, ", ".join(f"{k} {'string' if k == '__file' else 'long'}" for k in keys) + ", __base long")
    lost = F.raise_error(F.lit("the scan's blocks changed between two passes")).cast("long")
    return (made.join(broadcast_if_bounded(bases, len(rows)), keys, "left")
            .withColumn("__pos", F.when(F.col("__base").isNull(), lost).otherwise(F.col("__base") + F.col("__at"))))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given ``documents`` table as a corpus ordered by ``doc_id`` with
    its source name as metadata."""
    return table(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        F.col("doc_id").alias("pos"), "text", F.col("source").alias("meta"))
