"""Mixing sources to target weights: temperature mixing.

Source token shares are raised to an exponent and normalised; the exponent is
found by bisection, to meet a target entropy or a repetition limit; the weights
are then realised as budgeted block permutations: each source's documents lie
in hash blocks, an epoch passes through the blocks in a permuted order of its
own, and the last, partial epoch stops where the source's token budget is spent.

DataFrame functions only; the driver sees one scalar per bisection step.  A
source's documents are spread over ``BLOCKS`` blocks, so a hot source is never
one group, and the running totals are over at most ``BLOCKS`` rows a source.

Defined results: a null source counts as the source ``''``; a null or empty
text has no tokens, and is drawn with its block; repeated rows are drawn alike,
each on its own; an empty table gives an empty result; a corpus without any
token gives every source weight 0 and draws every document once.  A column of
the input named as one that is added (epoch, block, block_rank, mix_key)
is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibspark.llm.scratch import materialise, words

#: Blocks of a source; a budget is met to within one block (and a whole epoch is exact).
BLOCKS = 256
#: The exponent is a multiple of 2^-STEPS in [0, 1].
STEPS = 20
SEED = 17
#: No source is repeated more than this often for each time the least repeated one is used.
MAX_REPEATS = 2.0
#: Relative rounding allowed for in a budget.
NEAR = 1e-12


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, n_docs) over all documents."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def total_tokens(sources: DataFrame) -> float:
    return float(sources.agg(F.sum("tokens")).first()[0] or 0)


def powered(sources: DataFrame, alpha: float) -> DataFrame:
    return sources.where("tokens > 0").withColumn("p", F.pow(F.col("tokens") / F.lit(total_tokens(sources)), F.lit(alpha)))


def entropy(sources: DataFrame, alpha: float) -> float:
    """Entropy in nats of the weights at ``alpha``; it falls as alpha grows."""
    z, zlog = powered(sources, alpha).agg(F.sum("p"), F.sum(F.col("p") * F.ln("p"))).first()
    return math.log(z) - zlog / z if z else 0.0


def repeats(sources: DataFrame, alpha: float) -> float:
    """Epochs of the most repeated source for each of the least repeated one; it falls as alpha grows."""
    per = F.col("p") / F.col("tokens")
    hi, lo = powered(sources, alpha).agg(F.max(per), F.min(per)).first()
    return hi / lo if lo else 1.0


def bisect_exponent(fits) -> float:
    """Smallest multiple of 2^-STEPS in [0, 1] for which ``fits`` holds, 1 if none does; ``fits`` is monotone."""
    lo, hi = 0, 1 << STEPS
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid / (1 << STEPS)) else (mid + 1, hi)
    return min(lo, 1 << STEPS) / (1 << STEPS)


def mixing_weights(sources: DataFrame, target_entropy: float | None = None,
                   max_repeats: float | None = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """(source, tokens, n_docs, alpha, weight, budget): the flattest weights
    within the limits.  Without ``budget`` the mix holds as many tokens as let
    the least repeated source be used exactly once, so no document is lost."""
    fits = [lambda a: True]
    if target_entropy is not None:
        fits.append(lambda a: entropy(sources, a) <= target_entropy)
    if max_repeats is not None:
        fits.append(lambda a: repeats(sources, a) <= max_repeats)
    alpha = bisect_exponent(lambda a: all(f(a) for f in fits))
    rows = powered(sources, alpha)
    z, once = rows.agg(F.sum("p"), F.max(F.col("tokens") / F.col("p"))).first()
    share = F.col("tokens") / F.lit(total_tokens(sources) or 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0))
    total = F.lit(float(budget) if budget is not None else (once or 0.0) * (z or 0.0))
    # a double is off by some units of its last place: a budget that near to whole epochs is whole epochs
    want = weight * total
    epochs = F.round(want / F.col("tokens"))
    near = (epochs >= 1) & (F.abs(want - epochs * F.col("tokens")) <= want * NEAR)
    whole = F.when(near, epochs.cast("long") * F.col("tokens")).otherwise(F.floor(want * (1 + NEAR)))
    return (sources.withColumn("alpha", F.lit(alpha)).withColumn("weight", weight)
            .withColumn("budget", F.when(F.col("tokens") > 0, whole).otherwise(F.lit(0)).cast("long"))
            .select("source", "tokens", "n_docs", "alpha", "weight", "budget"))


def order_of(*cols: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def block_schedule(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, block, epoch, block_rank, mix_key): which blocks are drawn in
    which epoch.  ``mix_key`` in [0, 1) is the place in the mix: rows sorted by
    it see every source spread evenly over the whole run."""
    blocks = docs.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    rows = blocks.join(weights.select("source", "tokens", "budget"), "source")
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("__full", full).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__full"))))
    order = Window.partitionBy("source", "epoch").orderBy(order_of(F.col("source"), F.col("epoch"), F.col("block")), "block")
    rows = rows.withColumn("block_rank", F.row_number().over(order))
    spent = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__spent", F.col("epoch") * F.col("tokens") + spent)
    drawn = (F.col("epoch") < F.col("__full")) | ((F.col("tokens") > 0) & (F.col("__spent") <= F.col("budget")))
    key = F.when(F.col("tokens") > 0, (F.col("__spent") - F.col("block_tokens")) / F.greatest("budget", "tokens")).otherwise(F.lit(0.0))
    return rows.where(drawn).select("source", "block", "epoch", "block_rank", F.round(key, 9).alias("mix_key"))


def temperature_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
                    target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
                    budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with epoch, block,
    block_rank and mix_key.  Texts don't move: the schedule, at most sources x
    blocks x epochs rows, is joined to the documents by source and block."""
    src = F.coalesce(F.col(source_col), F.lit(""))
    block = F.pmod(order_of(F.col(id_col)), F.lit(blocks)).cast("int")
    counted = materialise(docs.select(src.alias("source"), block.alias("block"), F.size(words(text_col)).cast("long").alias("tokens"))
                          .groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "blocks")
    sources = materialise(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n_docs")), "sources")
    weights = mixing_weights(sources, target_entropy, max_repeats, budget)
    plan = materialise(block_schedule(counted, weights), "schedule")
    plan = plan.withColumnsRenamed({"source": "__source", "block": "__block"})
    added = {"epoch", "block", "block_rank", "mix_key"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    rows = docs.select(*own).withColumns({"__source": src, "__block": block})
    mixed = rows.join(plan, ["__source", "__block"])
    return mixed.withColumnRenamed("__block", "block").drop("__source")


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return temperature_mix(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "epoch", "block", "block_rank", "mix_key")
