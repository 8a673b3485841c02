"""Widths of padding batches without moving the id arrays.

A batch is a run of rows with consecutive ids.  Rows stored in id order have
nearly all batches whole inside one file block: their widths are taken in the
scan task.  Only the first and last batch of a block may go on in another; the
largest lengths of these (two per block) are gathered from the skinny (batch,
length) pairs first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.operators.arrival import rises, with_block
from calibspark.operators.bounded import broadcast_if_bounded
from calibspark.session import written


def _scan(rows: DataFrame, id_col: str, ids_col: str, batch_size: int) -> tuple[DataFrame, list, bool]:
    """(rows with their batch and length, blocks, whether they are stored in order)."""
    batch = F.floor(F.col(id_col) / batch_size).cast("long")
    made = with_block(rows.select("*", batch.alias("__batch"), F.size(ids_col).alias("__n")))
    blocks = made.groupBy("__pid", "__file", "__block").agg(F.min("__batch").alias("lo"), F.max("__batch").alias("hi")).orderBy("lo").collect()
    ordered = (all(r["__file"] for r in blocks) and all(a.hi <= b.lo for a, b in zip(blocks, blocks[1:]))
               and rises(made, "__batch", strict=False))
    return made, blocks, ordered


def with_batch_width(rows: DataFrame, id_col: str, ids_col: str, batch_size: int) -> DataFrame:
    """Add ``width``, the largest length of ``ids_col`` among the rows with the
    same ``id_col div batch_size``.  Rows that aren't stored in id order, or that
    don't come from files, are first written once in that order.  ``id_col`` must not be null."""
    made, blocks, ordered = _scan(rows, id_col, ids_col, batch_size)
    if not ordered:
        laid = written(rows.repartitionByRange(id_col).sortWithinPartitions(id_col), "in-order")
        made, blocks, ordered = _scan(laid, id_col, ids_col, batch_size)
        if not ordered:
            raise ValueError(f"{id_col} must not be null")
    edges = sorted({b for r in blocks for b in (r.lo, r.hi)})  # two per file block
    table = rows.sparkSession.createDataFrame([(e,) for e in edges], "__batch long")
    pairs = made.select("__batch", "__n").join(broadcast_if_bounded(table, len(edges)), "__batch")
    known = {r["__batch"]: r.w for r in pairs.groupBy("__batch").agg(F.max("__n").alias("w")).collect()}
    names = list(rows.columns)

    def widths(b: pa.RecordBatch) -> pa.RecordBatch:
        batch, n = (b.column(c).to_numpy() for c in ("__batch", "__n"))
        new = np.flatnonzero(np.diff(batch, prepend=batch[0] - 1))
        most = [known.get(x, m) for x, m in zip(batch[new].tolist(), np.maximum.reduceat(n, new).tolist())]
        width = np.repeat(np.array(most, np.int32), np.diff(np.append(new, len(batch))))
        return pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(width)], [*names, "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a batch that may go on
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            change = np.flatnonzero(np.diff(b.column("__batch").to_numpy()))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield widths(b.slice(0, cut))
            held = b.slice(cut)
        if held is not None:
            yield widths(held)

    schema = made.select(*names, F.lit(0).alias("width")).schema
    return made.select(*names, "__batch", "__n").mapInArrow(run, schema)
