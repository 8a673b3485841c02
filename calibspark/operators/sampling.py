"""Calibration sampling recipes (C1-C4, C7, C8, C11; A1, A12).

Selection works on a skinny projection (order, key, stratum, token count);
texts are re-read only for the selected rows (at most ``nsamples``) through
a broadcast join -- late materialisation instead of shuffling text.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from calibspark.functions.hashing import h48, hkey
from calibspark.functions.meta import (contains_any, extension, has_key, key_equals,
                                       key_int_at_least, language_from_path, parse_meta)
from calibspark.functions.tokens import WORDS, Tokenizer, head_tokens, window_tokens
from calibspark.operators.bounded import broadcast_if_bounded, rows_with_keys
from calibspark.session import written


# ---- fixed values: eligibility rules of the code and Q&A recipes ----------
CODE_SOURCE = "github"
CODE_EXTENSIONS = ["java", "py"]
QA_SOURCE = "stackexchange"
QA_RAW_MARKER = "stackoverflow"
QA_LANGUAGE = "en"
QA_MIN_SCORE = 10
QA_TOPICS = ["Python", "Java", "python", "java"]

SAMPLE_COLUMNS = ["sample_id", "doc_pos", "start", "num_tokens", "raw_data", "meta"]


_maybe_broadcast = broadcast_if_bounded


def length_gate(df: DataFrame, seqlen: int, strict: bool = True, n_col: str = "n_tokens") -> DataFrame:
    """More than (strict) or at least ``seqlen`` tokens."""
    n = F.col(n_col)
    return df.where(n > seqlen) if strict else df.where(n >= seqlen)


def with_token_count(df: DataFrame, text_col: str = "text", tok: Tokenizer = WORDS) -> DataFrame:
    return df.withColumn("n_tokens", tok.count(F.col(text_col)))


# ---------------------------------------------------------------- C1 / C7 / C8


def _fetch(corpus: DataFrame, keys: DataFrame, cols: list, bound_rows: int) -> DataFrame:
    """Rows at the selected positions (a bounded selection), filtered before
    any text work so only these rows are tokenized."""
    return rows_with_keys(corpus, keys.select("pos"), "pos", bound_rows).select("pos", *cols)


#: Position blocks of an eligibility index at most, and documents for each on average at least.
INDEX_BLOCKS, INDEX_ROWS = 4096, 64


@dataclass
class EligibleIndex:
    """The eligible documents of a corpus by position: ``table`` (pos, n_tokens,
    block), stored by block, and the number of them in each block."""

    table: DataFrame
    blocks: list[int]
    before: list[int]
    total: int

    def at_ranks(self, ranks: DataFrame) -> DataFrame:
        """(sample_id, pos, n_tokens) of the documents with the given ranks
        (sample_id, rank: a bounded selection).  Only the blocks that hold one are read."""
        spark = self.table.sparkSession
        if not self.total:
            return spark.createDataFrame([], "sample_id long, pos long, n_tokens int")
        asked = []
        for r in ranks.collect():
            i = bisect_right(self.before, r["rank"]) - 1
            asked.append((r["sample_id"], self.blocks[i], r["rank"] - self.before[i]))
        wanted = spark.createDataFrame(asked, "sample_id long, block long, place long")
        inside = self.table.where(F.col("block").isin(sorted({x[1] for x in asked})))
        place = F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1
        rows = inside.withColumn("place", place.cast("long")).join(_maybe_broadcast(wanted, len(asked)), ["block", "place"])
        return rows.select("sample_id", "pos", "n_tokens")


def eligible_index(corpus: DataFrame, seqlen: int, strict: bool = True, tok: Tokenizer = WORDS) -> EligibleIndex:
    """W2 for sampling: one scan of the corpus counts tokens; the positions and
    counts of the documents that pass the length gate are stored by position
    block.  Equal positions meet in a block and are an error."""
    lo, hi, n = corpus.agg(F.min("pos"), F.max("pos"), F.count(F.lit(1))).first()
    if lo is None:
        return EligibleIndex(corpus.select("pos", F.lit(0).alias("n_tokens"), F.lit(0).cast("long").alias("block")).limit(0), [], [], 0)
    width = -(-(hi - lo + 1) // min(INDEX_BLOCKS, max(1, n // INDEX_ROWS)))
    counted = length_gate(corpus.select("pos", tok.count(F.col("text")).alias("n_tokens")), seqlen, strict)
    block = F.floor((F.col("pos") - F.lit(lo)) / width).cast("long")
    twice = F.lag("pos").over(Window.partitionBy("block").orderBy("pos")) == F.col("pos")
    pos = F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.lit("duplicate position")).cast("long")).otherwise(F.col("pos"))
    table = written(counted.withColumn("block", block).withColumn("pos", pos), "eligible", partition_by="block")
    sizes = table.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()  # at most INDEX_BLOCKS rows
    before, total = [], 0
    for r in sizes:
        before.append(total)
        total += r.n
    return EligibleIndex(table, [r.block for r in sizes], before, total)


def random_windows(corpus: DataFrame, nsamples: int, seqlen: int, seed: int = 0,
                   strict: bool = True, tok: Tokenizer = WORDS, index: EligibleIndex | None = None) -> DataFrame:
    """C1 (strict) / C7 (inclusive): ``nsamples`` draws with replacement,
    uniform over the eligible documents, each cut at a uniform start in
    ``[0, n - seqlen - 1]`` (``0`` when n == seqlen, inclusive mode only).

    Draw ``k`` takes the eligible document of rank ``h48(seed|k|doc) mod E`` in
    position order, E being their number: a block of the index (J1) by the
    cumulative counts, then the rank in it.  An ``index`` made before for the same
    corpus, length and gate saves its scan.

    corpus: (pos, text, meta).  Output ``SAMPLE_COLUMNS``.
    """
    spark = corpus.sparkSession
    empty = spark.createDataFrame([], "sample_id long, doc_pos long, start int, num_tokens int, "
                                      "raw_data string, meta string")
    if nsamples <= 0:
        return empty
    index = index or eligible_index(corpus, seqlen, strict, tok)
    if not index.total:
        return empty
    k = F.col("id")
    ranks = spark.range(nsamples).select(k.alias("sample_id"), F.pmod(h48(hkey(F.lit(seed), k, F.lit("doc"))), F.lit(index.total)).alias("rank"))
    span = F.col("n_tokens") - seqlen
    off = F.pmod(h48(hkey(F.lit(seed), F.col("sample_id"), F.lit("off"))), span)
    start = off if strict else F.when(span == 0, F.lit(0)).otherwise(off)
    picked = written(index.at_ranks(ranks).select("sample_id", F.col("pos").alias("doc_pos"), start.cast("int").alias("start")), "picked")
    docs = _fetch(corpus, picked.select(F.col("doc_pos").alias("pos")), ["text", "meta"], nsamples) \
        .withColumnRenamed("pos", "doc_pos")
    joined = docs.join(_maybe_broadcast(picked, nsamples), "doc_pos")
    win = window_tokens(tok.encode(F.col("text")), F.col("start"), seqlen)
    return joined.select("sample_id", "doc_pos", "start", F.size(win).alias("num_tokens"),
                         tok.decode(win).alias("raw_data"), "meta")


def validation_windows(corpus: DataFrame, seqlen: int, n: int = 256, seed: int = 0,
                       tok: Tokenizer = WORDS, index: EligibleIndex | None = None) -> DataFrame:
    """``n`` inclusive windows with a fixed seed, laid end to end in draw
    order: ``offset`` is each window's position in the concatenation."""
    w = random_windows(corpus, n, seqlen, seed, strict=False, tok=tok, index=index)
    return w.withColumn("offset", (F.col("sample_id") * seqlen).cast("long"))


# ---------------------------------------------------------------- code recipe
def code_candidates(corpus: DataFrame, seqlen: int, tok: Tokenizer = WORDS) -> DataFrame:
    """P4-P7 + repo present + P1 on a code corpus (pos, text, meta):
    (pos, repo, language, n_tokens)."""
    m = parse_meta(F.col("meta"))
    base = corpus.select("pos", "text", m.alias("m"))
    path = F.col("m")["path"]
    filt = (base.where(F.col("m").isNotNull())
            .where(key_equals(F.col("m"), "source", CODE_SOURCE))
            .where(has_key(F.col("m"), "path"))
            .where(F.col("m")["repo_name"].isNotNull())
            .where(extension(path).isin(*CODE_EXTENSIONS)))
    skinny = filt.select("pos", F.col("m")["repo_name"].alias("repo"),
                         language_from_path(path).alias("language"),
                         tok.count(F.col("text")).alias("n_tokens"))
    return length_gate(skinny, seqlen, strict=True)


def quota_select(eligible: DataFrame, quota: int, strata: list[str], key: str = "repo",
                 stratum: str = "language", order: str = "pos",
                 prior_keys: DataFrame | None = None,
                 prior_counts: dict[str, int] | None = None) -> DataFrame:
    """C2 selection: greedy arrival-order sampling with at most ``quota`` rows
    per stratum and one row per key, in set form.  See ``quota_select_counts``."""
    return quota_select_counts(eligible, quota, strata, key, stratum, order, prior_keys, prior_counts)[0]


def quota_select_counts(eligible: DataFrame, quota: int, strata: list[str], key: str = "repo",
                        stratum: str = "language", order: str = "pos",
                        prior_keys: DataFrame | None = None,
                        prior_counts: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """C2 selection and the rows it accepted per stratum.

    Phase i accepts the first row of every key not yet taken, in the strata
    not yet full, up to the order value ``T_i`` at which the next stratum
    fills.  k strata need at most k phases; each phase is one fixed plan
    (a partial aggregate by key, a ``row_number() <= quota`` group limit per
    stratum).  The candidate rows of a phase are bounded by the quota, so
    one collect of their (order, stratum) gives ``T_i`` and the counts.

    ``prior_keys`` / ``prior_counts`` resume from an earlier selection over
    rows that all precede ``eligible`` (the incremental form).

    Returns ((order, key, stratum, phase), {stratum: accepted in this call}).
    """
    skinny = written(eligible.select(order, key, stratum), "eligible-keys")
    spark = eligible.sparkSession
    schema = StructType([skinny.schema[order], skinny.schema[key], skinny.schema[stratum], StructField("phase", IntegerType())])
    accepted: list[tuple] = []
    start = {s: (prior_counts or {}).get(s, 0) for s in strata}
    counts = dict(start)
    bound = quota * len(strata)
    if prior_keys is not None:
        skinny = skinny.join(_maybe_broadcast(prior_keys.select(key), bound), key, "left_anti")
    t_prev = None
    for phase in range(len(strata)):
        open_strata = [s for s in strata if counts[s] < quota]
        if not open_strata:
            break
        cand = skinny.where(F.col(stratum).isin(open_strata))
        if t_prev is not None:
            cand = cand.where(F.col(order) > F.lit(t_prev))
        if accepted:
            cand = cand.join(_maybe_broadcast(spark.createDataFrame(accepted, schema).select(key), bound), key, "left_anti")
        first = cand.groupBy(key).agg(F.min(F.struct(order, stratum)).alias("f")).select(
            key, F.col("f")[order].alias(order), F.col("f")[stratum].alias(stratum))
        rn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
        ranked = first.withColumn("__rn", rn).where(F.col("__rn") <= quota)
        rem = F.try_element_at(F.create_map(*[x for s in open_strata
                                              for x in (F.lit(s), F.lit(quota - counts[s]))]), F.col(stratum))
        kept = ranked.where(F.col("__rn") <= rem).select(order, key, stratum).collect()      # at most quota x strata rows
        by_stratum: dict[str, list] = {}
        for r in kept:
            by_stratum.setdefault(r[2], []).append(r[0])
        fills = [max(v) for s, v in by_stratum.items() if len(v) == quota - counts[s]]
        t = min(fills) if fills else None
        for s, v in by_stratum.items():
            counts[s] += sum(1 for x in v if t is None or x <= t)
        accepted += [(*r, phase) for r in kept if t is None or r[0] <= t]
        if t is None:
            break
        t_prev = t
    return spark.createDataFrame(accepted, schema), {s: counts[s] - start[s] for s in strata}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def pos_ranges(corpus: DataFrame, first_span: int | None = None, growth: int = 4,
               min_span: int = 1_000_000):
    """Geometric ``[lo, hi)`` ranges over the corpus order column.  Range
    filters on ``pos`` reach the Parquet scan, so a round reads only the row
    groups of its range when the corpus is stored in arrival order."""
    lo, hi = corpus.agg(F.min("pos"), F.max("pos")).first()
    if lo is None:
        return
    span = first_span or max((hi - lo + 1) // 1024, min_span)
    start = lo
    while start <= hi:
        yield start, start + span
        start += span
        span *= growth


def quota_sample(corpus: DataFrame, nsamples: int, seqlen: int, quota: int | None = None,
                 strata: list[str] | None = None, first_span: int | None = None,
                 growth: int = 4, tok: Tokenizer = WORDS) -> DataFrame:
    """Code recipe.  ``quota`` defaults to ``nsamples // 2`` per language.
    Output ``SAMPLE_COLUMNS + [language, repo]``; sample_id = acceptance order.

    Like the reference's lazy iterator, reading stops once every stratum is
    full: the corpus is consumed in growing ``pos`` ranges, each resuming the
    selection from the keys and counts accepted so far (exact, since every
    row of a range follows every row of the earlier ones).
    """
    quota = nsamples // 2 if quota is None else quota
    strata = strata or ["java", "python"]
    parts, counts = [], {s: 0 for s in strata}
    for lo, hi in pos_ranges(corpus, first_span, growth):
        chunk = corpus.where((F.col("pos") >= lo) & (F.col("pos") < hi))
        prior = _union(parts) if parts else None
        sel, got = quota_select_counts(code_candidates(chunk, seqlen, tok), quota, strata,
                                       prior_keys=prior, prior_counts=counts)
        sel = sel.select("pos", "repo", "language")
        for s_, n_ in got.items():
            counts[s_] += n_
        parts.append(sel)
        if all(counts[s] >= quota for s in strata):
            break
    if not parts:
        sel = corpus.sparkSession.createDataFrame([], "pos long, repo string, language string")
    else:
        sel = _union(parts)
    return _materialise_heads(corpus, sel, seqlen, bound_rows=quota * len(strata),
                              extra=["language", "repo"], tok=tok)


def _materialise_heads(corpus: DataFrame, sel: DataFrame, seqlen: int, bound_rows: int,
                       extra: list[str], tok: Tokenizer = WORDS) -> DataFrame:
    """Join selected positions back to their text (broadcast of the bounded
    selection), cut the first ``seqlen`` tokens (C11) and number by order."""
    docs = _fetch(corpus, sel, ["text", "meta"], bound_rows)
    joined = docs.join(_maybe_broadcast(sel, bound_rows), "pos")
    head = head_tokens(tok.encode(F.col("text")), seqlen)
    # selection is bounded by the quota, so a global row number is cheap
    sid = (F.row_number().over(Window.orderBy("pos")) - 1).cast("long")
    return joined.select(sid.alias("sample_id"), F.col("pos").alias("doc_pos"), F.lit(0).alias("start"),
                         F.size(head).alias("num_tokens"), tok.decode(head).alias("raw_data"), "meta", *extra)


def stratum_counts(sample: DataFrame, stratum: str = "language") -> DataFrame:
    """A1: rows per stratum."""
    return sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))


def shortage(sample: DataFrame, quota: int, strata: list[str], stratum: str = "language") -> DataFrame:
    """Requested vs obtained per stratum (replaces the reference's
    exhausted-iterator error).  One conditional aggregate, one row per
    stratum via ``inline`` -- no join."""
    got = sample.agg(*[F.count(F.when(F.col(stratum) == s, 1)).alias(f"n{i}") for i, s in enumerate(strata)])
    rows = F.array(*[F.struct(F.lit(s).alias(stratum), F.lit(quota).alias("requested"),
                              F.col(f"n{i}").alias("obtained")) for i, s in enumerate(strata)])
    return (got.select(F.inline(rows))
            .withColumn("missing", F.col("requested") - F.col("obtained")))


# ---------------------------------------------------------------- Q&A recipe
def qa_candidates(corpus: DataFrame, seqlen: int, tok: Tokenizer = WORDS) -> DataFrame:
    """P3, P4, P5, P8, P9, P10, P1 on a Q&A corpus: (pos, n_tokens)."""
    m = parse_meta(F.col("meta"))
    base = corpus.where(F.col("meta").contains(QA_RAW_MARKER)).select("pos", "text", m.alias("m"))
    mm = F.col("m")
    filt = (base.where(mm.isNotNull())
            .where(key_equals(mm, "source", QA_SOURCE))
            .where(key_equals(mm, "language", QA_LANGUAGE))
            .where(key_int_at_least(mm, "question_score", QA_MIN_SCORE))
            .where(contains_any(F.col("text"), QA_TOPICS)))
    return length_gate(filt.select("pos", tok.count(F.col("text")).alias("n_tokens")), seqlen)


def qa_head(corpus: DataFrame, k: int, seqlen: int, first_span: int | None = None,
            growth: int = 4, tok: Tokenizer = WORDS) -> DataFrame:
    """The first ``k`` eligible rows in arrival order, each cut to its first
    ``seqlen`` tokens.  Growing ``pos`` ranges, a top-k per range (no global
    sort); reading stops once ``k`` rows are found."""
    parts, found = [], 0
    for lo, hi in pos_ranges(corpus, first_span, growth):
        chunk = corpus.where((F.col("pos") >= lo) & (F.col("pos") < hi))
        top = qa_candidates(chunk, seqlen, tok).orderBy("pos").limit(k - found).select("pos")
        top = written(top, "head")
        found += top.count()
        parts.append(top)
        if found >= k:
            break
    if not parts:
        sel = corpus.sparkSession.createDataFrame([], "pos long")
    else:
        sel = _union(parts)
    return _materialise_heads(corpus, sel, seqlen, bound_rows=k, extra=[], tok=tok)


def mixed_sample(qa: DataFrame, code: DataFrame, nsamples: int, seqlen: int,
                 tok: Tokenizer = WORDS) -> DataFrame:
    """C4: ``nsamples // 2`` Q&A heads, then the code recipe with
    ``nsamples // 4`` per language; sample ids continue across parts."""
    n_qa = nsamples // 2
    a = qa_head(qa, n_qa, seqlen, tok=tok).withColumn("part", F.lit("qa"))
    b = quota_sample(code, nsamples // 2, seqlen, quota=nsamples // 4, tok=tok).drop("language", "repo")
    n_a = F.lit(n_qa).cast("long")
    b = b.withColumn("sample_id", F.col("sample_id") + n_a).withColumn("part", F.lit("code"))
    return a.unionByName(b)
