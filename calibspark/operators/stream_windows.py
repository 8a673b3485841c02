"""Windows over a concatenated corpus without building the concatenation
(W3, J4, C5, C6, C9).

The corpus is joined with a white-space separator.  Each document's piece
(``sep + text``; no separator before the first document) is tokenized on
its own: since separators are white space, the stream's tokens are the
pieces' tokens, except that a piece's trailing white space (its *tail*)
belongs to the next token of the stream.  A window of global tokens
``[s, e]`` is therefore the ordered concatenation, over overlapping pieces,
of the piece tokens inside ``[s, e]`` plus the piece tail when the next
global token lies inside ``[s, e]``.

Global token offsets are running sums in arrival order, taken in the scan
tasks themselves (``arrival.py``); ``stream_offsets`` gives them as a table.  Random
windows are found from the document side by binary search, and regular chunks
are cut there: a chunk that lies inside one document leaves its scan task
whole.  Only the fragments at documents' edges are grouped, each bounded by
the window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibspark.functions.hashing import h48, hkey
from calibspark.functions.tokens import token_count, tokenize
from calibspark.operators.arrival import Arrival
from calibspark.operators.bounded import broadcast_if_bounded
from calibspark.session import written

ROWS_PER_BUCKET = 2_000_000


def range_buckets(df: DataFrame, order: list, out_col: str, n_buckets: int | None = None, rows: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``order`` of about equal row counts, numbered
    in order by ``out_col``; written to the shared folder, so that every reader
    sees the same cut.  At least one range for each ``ROWS_PER_BUCKET`` rows and
    for each shuffle partition."""
    if n_buckets is None:
        rows = df.count() if rows is None else rows
        n_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))
    # a plain shuffle into exactly these ranges, each sorted, numbered by its partition
    ranged = df.repartitionByRange(n_buckets, *order).withColumn(out_col, F.spark_partition_id())
    return written(ranged, "ranges")


def running_offset(df: DataFrame, order_col: str, value_col: str, n_buckets: int | None = None,
                   out_col: str = "offset") -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_col`` order.

    The rows are cut into ranges of the order column; a window runs inside
    each range, and the base of a range is the running sum over the table of
    range totals (one row per range).  One path at every size.
    """
    with_b = range_buckets(df, [order_col], "__rb", n_buckets)
    w_in = Window.partitionBy("__rb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = with_b.withColumn("__in", F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
    totals = with_b.groupBy("__rb").agg(F.sum(value_col).alias("__tot"))
    # one row per range
    w_b = Window.orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__rb", F.coalesce(F.sum("__tot").over(w_b), F.lit(0)).alias("__base"))
    return (inner.join(base, "__rb")
            .withColumn(out_col, (F.col("__base") + F.col("__in")).cast("bigint"))
            .drop("__rb", "__in", "__base"))


class TokenStream:
    """The pieces of a separator-joined corpus and their token offsets.
    ``total``: tokens in the stream."""

    def __init__(self, corpus: DataFrame, sep: str):
        self.sep = sep
        # a missing text is an empty piece
        self.arrival = Arrival(corpus, F.coalesce(token_count(F.col("text")), F.lit(0)))
        self.total = self.arrival.total

    def pieces(self, **options) -> DataFrame:
        """(pos, w, cum, piece, ...) of ``Arrival.located``."""
        text = F.col("text")
        piece = F.when(F.col("pos") == F.lit(self.arrival.first_pos), text).otherwise(F.concat(F.lit(self.sep), text))
        return self.arrival.located(fold=self.sep, **options).withColumn("piece", piece).drop("text")


def _tail(tokens: Column, piece: Column) -> Column:
    """White space after the piece's last token (the whole piece if wordless)."""
    return F.substr(piece, (F.length(F.array_join(tokens, "")) + 1).cast("int"))


def _fragment(tokens: Column, tail: Column, cum: Column, w: Column, s: Column, e: Column) -> Column:
    """Text a piece contributes to the global token window ``[s, e]``."""
    lo = F.greatest(s, cum)
    hi = F.least(e, cum + w - 1)
    n_in = hi - lo + 1
    body = F.when(n_in > 0, F.array_join(F.slice(tokens, (lo - cum + 1).cast("int"), n_in.cast("int")), "")) \
        .otherwise(F.lit(""))
    nxt = cum + w
    return F.concat(body, F.when((nxt >= s) & (nxt <= e), tail).otherwise(F.lit("")))


def _assemble(frags: DataFrame, key: str) -> DataFrame:
    """Group fragments per window, concatenated in piece order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "frag")))
    return frags.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["frag"]), "").alias("raw_data"))


def _with_tokens(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("toks", tokenize(F.col("piece"))).withColumn("tail", _tail(F.col("toks"), F.col("piece")))


def stream_windows(corpus: DataFrame, nsamples: int, seqlen: int, sep: str = "\n\n", seed: int = 0) -> DataFrame:
    """``nsamples`` random windows of ``seqlen`` tokens over the whole
    separator-joined corpus; start uniform in ``[0, total - seqlen - 1]``.
    The windows' starts (``nsamples`` of them) go to the scan tasks as one sorted array."""
    stream = TokenStream(corpus, sep)
    spark = corpus.sparkSession
    span = stream.total - seqlen
    if span <= 0 or nsamples <= 0:
        return spark.createDataFrame([], "sample_id long, start long, num_tokens int, raw_data string")
    k = F.col("id")
    s = F.pmod(h48(hkey(F.lit(seed), k, F.lit("off"))), F.lit(span))
    wins = spark.range(nsamples).select(k.alias("sample_id"), s.alias("start"))
    drawn = sorted((r.start, r.sample_id) for r in wins.collect())  # nsamples rows
    starts, ids = (np.array([x[i] for x in drawn], np.int64) for i in (0, 1))
    touched = _with_tokens(stream.pieces(windows=(ids, starts), length=seqlen))
    rows = touched.select("pos", "cum", "w", "toks", "tail", F.inline(F.arrays_zip("ids", "starts")))
    frag = _fragment(F.col("toks"), F.col("tail"), F.col("cum"), F.col("w"), F.col("starts"), F.col("starts") + seqlen - 1)
    out = _assemble(rows.select(F.col("ids").alias("sample_id"), "pos", frag.alias("frag")), "sample_id")
    return (out.join(broadcast_if_bounded(wins, nsamples), "sample_id")
            .select("sample_id", "start", F.lit(seqlen).alias("num_tokens"), "raw_data"))


def _chunks(stream: TokenStream, seqlen: int, limit_tokens: int) -> DataFrame:
    """Regular chunks ``[c*seqlen, min((c+1)*seqlen, limit) - 1]``: (chunk_id,
    num_tokens, raw_data).  A chunk inside one piece, not at its start (where white
    space of the piece before belongs to the token), is cut in the scan task; the
    others are put together from the pieces' edges."""
    total = min(stream.total, limit_tokens)
    if total <= 0:
        return stream.arrival.corpus.sparkSession.createDataFrame([], "chunk_id long, num_tokens int, raw_data string")
    pieces = stream.pieces().where(F.col("cum") <= F.lit(total - 1))
    cum, w, first = F.col("cum"), F.col("w"), F.col("pos") == F.lit(stream.arrival.first_pos)
    # the chunks inside the piece: none if they end before they begin
    begin = F.floor((cum + F.when(first, seqlen - 1).otherwise(seqlen)) / seqlen)
    end = F.least(F.floor((cum + w) / seqlen), F.lit(total // seqlen)) - 1
    pieces = pieces.withColumns({"c0": begin.cast("long"), "c1": end.cast("long")})
    c0, c1 = F.col("c0"), F.col("c1")
    inside = _with_tokens(pieces.where(c1 >= c0)).select(F.inline(F.transform(F.sequence(c0, c1), lambda c: F.struct(
        c.alias("chunk_id"), F.lit(seqlen).alias("num_tokens"),
        F.array_join(F.slice(F.col("toks"), (c * seqlen - cum + 1).cast("int"), F.lit(seqlen)), "").alias("raw_data")))))
    a, b = F.floor(cum / seqlen).cast("long"), F.least(F.floor((cum + w) / seqlen), F.lit((total - 1) // seqlen)).cast("long")
    # the chunks that the piece touches but for those inside
    outer = F.when(c1 < c0, F.sequence(a, b)).otherwise(F.concat(
        F.when(a < c0, F.sequence(a, c0 - 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(b > c1, F.sequence(c1 + 1, b)).otherwise(F.array().cast("array<bigint>"))))

    def edge(c):
        s = c * seqlen
        return F.struct(c.alias("chunk_id"), _fragment(F.col("toks"), F.col("tail"), cum, w, s, F.least(s + seqlen, F.lit(total)) - 1).alias("frag"))

    edges = _with_tokens(pieces.where(a <= b).withColumn("outer", outer).where(F.size("outer") > 0)).select(
        "pos", F.inline(F.transform(F.col("outer"), edge)))
    n = F.least(F.lit(seqlen), F.lit(total) - F.col("chunk_id") * seqlen).cast("int")
    return inside.unionByName(_assemble(edges, "chunk_id").select("chunk_id", n.alias("num_tokens"), "raw_data"))


def encode_stream(corpus: DataFrame, seqlen: int, sep: str = "\n\n") -> DataFrame:
    """The whole stream as consecutive ``seqlen``-token chunks (last one
    may be shorter): (chunk_id, num_tokens, raw_data)."""
    stream = TokenStream(corpus, sep)
    return _chunks(stream, seqlen, stream.total)


def token_budget(corpus: DataFrame, seqlen: int, ndocs: int = 1100, n_chunks: int = 256, sep: str = " ") -> DataFrame:
    """The first ``ndocs`` documents joined by ``sep``, cut to the first
    ``n_chunks * seqlen`` tokens, as chunks (chunk_id, num_tokens, raw_data).
    The head is found on the ``pos`` column alone (a top-k); its text is then
    read through a range filter that reaches the scan."""
    cut = corpus.select("pos").orderBy("pos").limit(ndocs).agg(F.max("pos")).first()[0]
    head = corpus.where(F.col("pos") <= F.lit(cut)) if cut is not None else corpus.limit(0)
    return _chunks(TokenStream(head, sep), seqlen, n_chunks * seqlen)


def stream_offsets(corpus: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """W3 as a table: (pos, n_tokens, offset) -- offset = tokens before the piece."""
    skinny = corpus.select("pos", token_count(F.col("text")).alias("n_tokens"))
    return running_offset(skinny, "pos", "n_tokens", n_buckets, "offset")
