"""Train / validation split of a calibration sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.functions.hashing import h48, hkey
from calibspark.operators.bounded import broadcast_if_bounded


def split_train_val(sample: DataFrame, val_size: int, seed: int = 0,
                    id_col: str = "sample_id") -> DataFrame:
    """A seeded permutation (hash order); its first ``val_size`` rows are
    validation, the rest train.  The validation ids are a top-k (bounded by
    ``val_size``) joined back by broadcast; no global sort."""
    rank_key = h48(hkey(F.lit(seed), F.col(id_col)))
    val_ids = (sample.select(id_col, rank_key.alias("__r"))
               .orderBy("__r", id_col).limit(val_size)
               .select(id_col, F.lit("val").alias("split")))
    return (sample.join(broadcast_if_bounded(val_ids, val_size), id_col, "left")
            .withColumn("split", F.coalesce(F.col("split"), F.lit("train"))))


def split_token_totals(split_sample: DataFrame) -> DataFrame:
    """A2 / A3: sequences and tokens per split."""
    return split_sample.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum("num_tokens").cast("long").alias("total_tokens"))


def pretokenized_head(df: DataFrame, n: int, order_col: str = "sample_id") -> DataFrame:
    """The first ``n`` sequences of a pre-tokenized table (top-k)."""
    return df.orderBy(order_col).limit(n)
