"""Running offsets in arrival order without moving the rows.

A scan reads each file block from its start, so rows of one block come in file
order.  One skinny pass takes a total for each block (one row per block), and
the blocks' order gives each block's base.  A second pass over the same scan
adds up the rows' own weights from the base on, in the scan task itself: no
row is shuffled, and nothing of the size of the rows is broadcast.

This needs a corpus whose positions rise within the blocks, and whose blocks
don't overlap, as a corpus stored in arrival order has them.  Any other corpus
is first written once in position order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibspark.operators.bounded import broadcast_if_bounded
from calibspark.session import written

_KEYS = ["__pid", "__file", "__block"]


def with_block(rows: DataFrame) -> DataFrame:
    """Add the scan's task and file block of each row."""
    return rows.select("*", F.spark_partition_id().alias("__pid"), F.input_file_name().alias("__file"), F.input_file_block_start().alias("__block"))


def rises(rows: DataFrame, pos: str, strict: bool = True) -> bool:
    """No row of a block comes after one with a larger position (or an equal one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        bad = False
        for b in batches:
            at, key = b.column(0).to_numpy(), b.column(1).dictionary_encode()
            for code, name in enumerate(key.dictionary.to_pylist()):
                own = at[key.indices.to_numpy() == code]
                bad |= bool((np.diff(own, prepend=last.get(name, own[0] - 1)) < int(strict)).any())
                last[name] = own[-1]
        if bad:
            yield pa.RecordBatch.from_pydict({"bad": [1]})

    key = F.concat_ws("|", "__file", F.col("__block").cast("string")).alias("key")
    return rows.select(F.col(pos).cast("long"), key).mapInArrow(run, "bad long").isEmpty()


class Arrival:
    """A corpus (pos, text) with a weight per row, in arrival order.

    ``first_pos``, ``n_rows``, ``total`` (sum of the weights); ``located`` gives
    the rows with the weights before them.
    """

    def __init__(self, corpus: DataFrame, weight: Column):
        self.weight = weight
        self._scan(corpus.select("pos", "text"))
        if not self._in_order():
            self._scan(written(self.corpus.repartitionByRange("pos").sortWithinPartitions("pos"), "in-order"))
            if not self._in_order():
                raise ValueError("pos must be unique")
        sums = np.cumsum([0] + [r.w for r in self.blocks])
        self.bases, self.total = sums[:-1], int(sums[-1])
        self.first_pos = self.blocks[0].lo if self.blocks else None
        self.n_rows = sum(r.n for r in self.blocks)

    def _scan(self, corpus: DataFrame) -> None:
        self.corpus = corpus
        self.rows = with_block(corpus.select("pos", "text", self.weight.cast("long").alias("w")))
        got = self.rows.groupBy(*_KEYS).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"),
                                            F.count("pos").alias("m"), F.sum("w").alias("w")).collect()  # one row per file block
        if any(r.n != r.m for r in got):
            raise ValueError("pos must not be null")
        self.blocks = sorted(got, key=lambda r: r.lo)

    def _in_order(self) -> bool:
        """The rows come from files, and their blocks follow each other."""
        return all(r["__file"] for r in self.blocks) and all(a.hi < b.lo for a, b in zip(self.blocks, self.blocks[1:])) and rises(self.rows, "pos")

    def located(self, windows: tuple[np.ndarray, np.ndarray] | None = None, length: int = 0, fold: str | None = None) -> DataFrame:
        """(pos, text, w, cum): ``cum`` is the sum of the weights before the row.

        With ``windows`` (ids, starts in rising order), each ``length`` long, only rows that
        touch one come, with the arrays ``ids`` and ``starts`` of theirs: a binary search per row.
        With ``fold``, neighbouring rows without weight become one, joined by it."""
        spark = self.corpus.sparkSession
        table = [(r["__pid"], r["__file"], r["__block"], i, int(b)) for i, (r, b) in enumerate(zip(self.blocks, self.bases))]
        blocks = spark.createDataFrame(table, "__pid int, __file string, __block long, seg long, base long")
        rows = (self.rows.join(broadcast_if_bounded(blocks, len(table)), _KEYS, "left")
                .select("pos", F.coalesce("text", F.lit("")).alias("text"), "w", "seg", "base"))
        schema = "pos long, text string, w long, cum long" + (", ids array<long>, starts array<long>" if windows is not None else "")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, reached = -1, 0
            for b in batches:
                if not b.num_rows:
                    continue
                if b.column("seg").null_count:
                    raise ValueError("the scan's blocks changed between two passes")
                w, seg, base = (b.column(c).to_numpy() for c in ("w", "seg", "base"))
                new = np.flatnonzero(np.diff(seg, prepend=-1))
                before = np.cumsum(w) - w
                origin = base[new] - before[new]
                if seg[0] == current:
                    origin[0] = reached - before[0]
                cum = before + np.repeat(origin, np.diff(np.append(new, len(seg))))
                current, reached = seg[-1], cum[-1] + w[-1]
                keep = np.ones(len(seg), bool)
                columns = [b.column("pos"), b.column("text"), b.column("w"), pa.array(cum)]
                if fold is not None:
                    texts, keep = folded(columns[1], (w == 0) & (cum >= 0), seg, fold)
                    columns[1] = texts
                if windows is not None:
                    ids, starts = windows
                    lo, hi = np.searchsorted(starts, cum - length + 1), np.searchsorted(starts, cum + w, side="right")
                    keep &= hi > lo
                    columns += [pa.array([a[x:y] if k else None for x, y, k in zip(lo, hi, keep)], pa.list_(pa.int64())) for a in (ids, starts)]
                out = pa.RecordBatch.from_arrays(columns, ["pos", "text", "w", "cum", *(["ids", "starts"] if windows is not None else [])])
                yield out.filter(pa.array(keep))

        return rows.mapInArrow(run, schema)


def folded(texts: pa.Array, blank: np.ndarray, seg: np.ndarray, sep: str) -> tuple[pa.Array, np.ndarray]:
    """(texts, rows that stay): each run of blank rows of one block is its first row, joined by ``sep``."""
    keep = np.ones(len(blank), bool)
    goes_on = blank[1:] & blank[:-1] & (seg[1:] == seg[:-1])
    keep[1:] = ~goes_on
    if keep.all():
        return texts, keep
    values = texts.to_pylist()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], goes_on, [False]]).astype(np.int8)))
    for first, last in zip(edge[::2], edge[1::2]):
        values[first] = sep.join(values[first:last + 1])
    return pa.array(values, texts.type), keep
