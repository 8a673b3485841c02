"""Repeated passages by the common-prefix interval tree of suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller document, or same document and earlier start) is removed.  Exact, over
whole texts, with matches within documents only.

A suffix array of the whole corpus would move each byte many times.  Instead:

1. Scan.  In each window of ``length`` bytes the k-gram with the smallest hash
   is the window's anchor, so equal windows have equal anchors at equal
   offsets.  Neighbouring windows share anchors: a run is the windows of one
   anchor, and one skinny row (anchor hash, run hash, document, place) stands
   for it, one in about 35 bytes.  Runs with equal content within one batch are
   settled there; of an anchor with many different runs in a batch all but one
   are known as repeated and are dealt apart, so a passage that a third of the
   documents share doesn't gather in one task.
2. One shuffle by anchor.  Streaming over sorted rows drops anchors that occur
   once, settles runs with equal content (all but the first are removed), and
   leaves the first of each content where an anchor has several contents: the
   ends of passages.
3. Only those runs' bytes are fetched.  Runs of one anchor meet in one block
   (at most ``GROUP`` of them; a larger group is dealt into salted parts), and
   a block gets an enhanced suffix array: suffix order by prefix doubling, then
   the common prefixes of neighbours.  A stack scan yields the interval tree;
   an interval whose members have different left neighbours is a maximal
   repeat, with all its occurrences.  In each interval all but the first
   occurrence are covered to the interval's depth.
4. Windows of salted groups that are first or alone in their part meet once
   more by the hash of their bytes, aggregated to the first place, so that
   nothing is lost between the parts.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; ids that are null or occur twice are ordered nulls first, then by
text, each row a document of its own; rows that repeat another one are removed
like any copy; an empty table gives an empty result; other columns are not
read (and kept as they are by ``cut_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.scratch import materialise
from calibspark.llm.wordhash import mix, prefix_sums, span_hashes

LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 32
#: Runs of one anchor that meet in one part of a block; different runs of an anchor in a batch that go on unsalted.
GROUP, PLAIN = 8192, 4
#: Bytes scanned together (positions fit in 20 bits), and bytes of runs in one suffix array.
CHUNK, BLOCK = 1_000_000, 1_000_000
#: Bytes of runs handed on together.
FETCH = 4 << 20

NEW, ANNOUNCED, KNOWN, COPY = 0, 1, 2, 3


# ---------------------------------------------------------------- 1. scan
def chunk_runs(data: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """Runs of a chunk of concatenated texts: (text, first window start, last
    window start, anchor place, anchor hash, run hash), places in the chunk."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    sums = prefix_sums(data)
    at = np.arange(len(data) - anchor + 1)
    grams = mix(span_hashes(sums, at, at + anchor))
    low = np.uint64((1 << 20) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, reach = length - anchor + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
    text = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + length <= ends[text]
    place = (least[:n] & low).astype(np.int64)
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return None
    return text[first], first, last, place[first], grams[place[first]], mix(span_hashes(sums, first, last + length) + np.uint64(1))


def batch_runs(texts: list[bytes], length: int, anchor: int):
    """Runs of a batch of texts: (row, first, last, place, anchor hash, run hash), places in the text."""
    parts, held, size = [], [], 0  # held: (row, offset in the text, bytes)

    def flush():
        if held:
            data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            ends = np.cumsum([len(x[2]) for x in held])
            if (got := chunk_runs(data, ends, length, anchor)) is not None:
                text, first, last, place, gram, run = got
                shift = np.array([x[1] for x in held])[text] - (ends - [len(x[2]) for x in held])[text]
                parts.append((np.array([x[0] for x in held])[text], first + shift, last + shift, place + shift, gram, run))
            held.clear()

    for row, t in enumerate(texts):
        for off in range(0, max(1, len(t) - length + 1), CHUNK - length):
            piece = t[off:off + CHUNK - 1]  # window starts off .. off + CHUNK - length - 1
            if size + len(piece) > CHUNK:
                flush()
                size = 0
            held.append((row, off, piece))
            size += len(piece)
    flush()
    if not parts:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*parts)]


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def scan(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, run, doc, place, kind) of every run; ``place`` packs the
    anchor's place (from bit 16), its offset in the run's first window (bits 8
    to 15) and the run's windows less one."""
    assert length - anchor < 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            row, first, last, at, gram, content = batch_runs(texts, length, anchor)
            doc = b.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            place = at << 16 | (at - first) << 8 | (last - first)
            order = np.lexsort((place, doc, content, gram))
            doc, place, gram, content = doc[order], place[order], gram[order], content[order]
            kind = np.full(len(doc), COPY, np.int8)
            kind[group_starts(gram, content)] = NEW
            # of an anchor with many different runs one announces it, the others are known to be repeated
            fresh = np.flatnonzero(kind == NEW)
            start = group_starts(gram[fresh])
            n = np.diff(np.append(start, len(fresh)))
            many = np.repeat(n >= PLAIN, n)
            kind[fresh[many]] = KNOWN
            kind[fresh[start[n >= PLAIN]]] = ANNOUNCED
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array((content >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 pa.array(doc), pa.array(place), pa.array(kind)], ["anchor", "run", "doc", "place", "kind"])

    return docs.select("rid", "text").mapInArrow(run, "anchor long, run int, doc long, place long, kind byte")


# ---------------------------------------------------------------- 2. repeated anchors
def settle(anchor, run, doc, place, kind):
    """Of complete anchor groups, sorted by (anchor, run, doc, place): masks of
    the rows whose windows all start earlier too, and of those to be looked at."""
    copy = kind == COPY
    known = kind == KNOWN
    live = np.flatnonzero(~copy & ~known)  # NEW and ANNOUNCED rows of an anchor are all here
    open_ = known.copy()
    if len(live):
        a, r = anchor[live], run[live]
        start = group_starts(a)
        n = np.diff(np.append(start, len(live)))
        of_run = np.zeros(len(live), bool)
        of_run[group_starts(a, r)] = True
        runs = np.add.reduceat(of_run.astype(np.int64), start)
        told = np.add.reduceat((kind[live] == ANNOUNCED).astype(np.int64), start) > 0
        copy[live[~of_run]] = True
        open_[live] = of_run & np.repeat((runs > 1) | told, n)
    return copy, open_


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Rows (anchor, doc, place, copied) of step 2."""
    own = F.when(F.col("kind") <= ANNOUNCED, F.col("anchor")).otherwise(F.xxhash64("anchor", "doc", "place"))
    rows = runs.repartition(own).sortWithinPartitions("anchor", "run", "doc", "place")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last anchor may go on
            held = [c[cut:].copy() for c in cols]
            yield from emit([c[:cut] for c in cols])
        if held is not None:
            yield from emit(held)

    def emit(cols) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            copy, open_ = settle(*cols)
            keep = np.flatnonzero(copy | open_)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][keep]), pa.array(cols[2][keep]), pa.array(cols[3][keep]),
                                              pa.array(copy[keep])], ["anchor", "doc", "place", "copied"])

    return rows.mapInArrow(stream, "anchor long, doc long, place long, copied boolean")


# ---------------------------------------------------------------- 3. enhanced suffix arrays
class SuffixArray:
    """Suffixes of several texts that have at least ``least`` bytes left,
    sorted, with the common prefix of each and the one before it."""

    STEPS = (7, 14, 28, 56, 112)

    def __init__(self, texts: list[bytes], least: int):
        sizes = np.array([len(t) for t in texts])
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        data[self.begin + sizes] = 0  # between texts
        n = len(data)
        pad = np.concatenate([data, np.zeros(256, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = key << 9 | pad[i:n + i]
        ranks = []
        for step in self.STEPS:
            order = np.argsort(key, kind="stable")
            rank = np.zeros(n + 256, np.int32)
            new = np.ones(n, np.int32)
            new[1:] = key[order][1:] != key[order][:-1]
            rank[order] = np.cumsum(new)
            ranks.append(rank)
            key = rank[:n].astype(np.int64) * (n + 2) + rank[step:n + step]
        order = np.argsort(key, kind="stable")
        self.text = np.repeat(np.arange(len(texts)), sizes + 1)
        left = (self.begin + sizes)[self.text] - np.arange(n)
        self.sa = order[left[order] >= least]
        self.offset = self.sa - self.begin[self.text[self.sa]]
        self.left = left[self.sa]
        a, b = self.sa[:-1], self.sa[1:]
        lcp = np.zeros(len(a), np.int64)
        for step, rank in zip(self.STEPS[::-1], ranks[::-1]):
            lcp += step * (rank[a + lcp] == rank[b + lcp])
        going = np.ones(len(a), bool)
        for _ in range(7):
            going &= pad[a + lcp] == pad[b + lcp]
            lcp += going
        self.lcp = np.zeros(len(self.sa), np.int64)
        self.lcp[1:] = np.minimum(lcp, np.minimum(self.left[:-1], self.left[1:]))
        # what stands left of a suffix; the start of a text differs from all
        self.before = np.where(self.offset > 0, pad[self.sa - 1], -1 - self.text[self.sa])

    def intervals(self, least: int, order: np.ndarray) -> Iterator[tuple[int, int, int, bool, list[tuple[int, int]]]]:
        """Common-prefix intervals of depth ``least`` or more, children first:
        (first, last, depth, maximal, lost).  ``order`` gives each suffix its
        place in the corpus; ``lost`` are the members that are first in their
        child interval (or alone), but not in this one.  ``maximal``: the
        members don't all have the same left neighbour."""
        lcp, before, order = self.lcp.tolist(), self.before.tolist(), order.tolist()
        n = len(lcp)
        stack: list[list] = []  # depth, first, firsts of the children, left neighbour (None: several)

        def leaf(i):
            return [None, i, [i], before[i]]

        def join(node, child):
            node[2] += child[2]
            if node[3] != child[3] or node[3] is None:
                node[3] = None

        last = None
        for i in range(n + 1):
            depth = lcp[i] if 0 < i < n else 0
            node = last  # the interval or leaf that ends before suffix i
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                if node is not None:
                    join(top, node)
                first = min(top[2], key=order.__getitem__)
                yield top[1], i - 1, top[0], top[3] is None, [x for x in top[2] if x != first]
                top[2] = [first]
                node = top
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    if node is not None:
                        join(stack[-1], node)
                elif node is not None:
                    stack.append([depth, node[1], list(node[2]), node[3]])
                last = leaf(i)
            else:
                last = leaf(i) if i < n else None


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (text, offset)) of every maximal repeat of at
    least ``least`` bytes in a bounded list of texts."""
    if not texts:
        return
    array = SuffixArray(texts, least)
    who = array.text[array.sa]
    for lo, hi, depth, maximal, _ in array.intervals(least, np.lexsort((array.offset, who)).argsort()):
        if maximal:
            yield depth, sorted(zip(who[lo:hi + 1].tolist(), array.offset[lo:hi + 1].tolist()))


def block_spans(doc: np.ndarray, start: np.ndarray, texts: list[bytes], length: int):
    """(doc, start, end) of the spans that also start earlier within the
    block, then of all its windows the text, the offset and whether it is
    such a span's start."""
    array = SuffixArray(texts, length)
    who = array.text[array.sa]
    at = start[who] + array.offset
    rank = np.lexsort((at, doc[who])).argsort()
    depth = np.zeros(len(array.sa), np.int64)
    for _, _, d, _, lost in array.intervals(length, rank):
        depth[lost] = d
    hit = depth > 0
    return doc[who[hit]], at[hit], at[hit] + depth[hit], who, array.offset, hit


def unite(doc, start, end):
    """Maximal runs of spans, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    big = int(max(end.max(), 0)) + 2
    code = np.unique(doc, return_inverse=True)[1].astype(np.int64) * big
    reach = np.maximum.accumulate(code + end)
    new = np.ones(len(doc), bool)
    new[1:] = (code + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach[last] - code[last])


SPAN = "doc long, start long, end long"


def span_batch(doc, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, start, end)], ["doc", "start", "end"])


def fetch_runs(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(block, hot, doc, start, bytes): the bytes of runs (block, hot, doc, place), by one join on the document."""
    wanted = runs.groupBy(F.col("doc").alias("rid")).agg(F.collect_list(F.struct("block", "hot", "place")).alias("runs"))
    rows = docs.select("rid", "text").join(wanted, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("runs")
            block, hot, place = lists.flatten().flatten()
            place = place.to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(b.column("rid").to_numpy(), n)
            start = (place >> 16) - (place >> 8 & 255)
            end = start + (place & 255) + length
            held, size, first, at = [], 0, 0, 0
            for text, m in zip(b.column("text"), n):
                data = text.as_py().encode("utf-8", "surrogatepass")
                held += [data[x:y] for x, y in zip(start[at:at + m].tolist(), end[at:at + m].tolist())]
                size += int((end[at:at + m] - start[at:at + m]).sum())
                at += m
                if size > FETCH or at == len(place):
                    yield pa.RecordBatch.from_arrays([block[first:at], hot[first:at], pa.array(doc[first:at]), pa.array(start[first:at]),
                                                      pa.array(held, pa.binary())], ["block", "hot", "doc", "start", "bytes"])
                    held, size, first = [], 0, at

    return rows.mapInArrow(run, "block long, hot boolean, doc long, start long, bytes binary")


def compare_blocks(fetched: DataFrame, length: int) -> DataFrame:
    """Suffix arrays over blocks: rows (doc, start, end, window).  ``window`` is
    null for a span that starts earlier too; in hot groups every other window
    is a row of its own with the hash of its bytes."""
    rows = fetched.repartition("block").sortWithinPartitions("block", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            cols = zip(*(b.column(i).to_pylist() for i in range(5)))
            for block, hot, doc, start, data in cols:
                if size > BLOCK and held[-1][0] != block:
                    yield from emit(held)
                    held, size = [], 0
                held.append((block, hot, doc, start, data))
                size += len(data)
        if held:
            yield from emit(held)

    def emit(held) -> Iterator[pa.RecordBatch]:
        _, hot, doc, start, texts = zip(*held)
        hot, doc, start = np.array(hot), np.array(doc, np.int64), np.array(start, np.int64)
        d, s, e, who, offset, hit = block_spans(doc, start, list(texts), length)
        d, s, e = unite(d, s, e)
        window = [None] * len(d)
        rest = np.flatnonzero(hot[who] & ~hit)
        if len(rest):
            sizes = np.array([len(t) for t in texts])
            begin = (np.cumsum(sizes) - sizes)[who[rest]] + offset[rest]
            value = mix(span_hashes(prefix_sums(np.frombuffer(b"".join(texts), np.uint8)), begin, begin + length))
            at = start[who[rest]] + offset[rest]
            d, s, e = np.concatenate([d, doc[who[rest]]]), np.concatenate([s, at]), np.concatenate([e, at + length])
            window += value.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (d, s, e)), pa.array(window, pa.int64())],
                                         ["doc", "start", "end", "window"])

    return rows.mapInArrow(run, SPAN + ", window long")


def removable_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, end) spans of bytes to remove, overlapping ones included;
    ``docs`` has (rid, text), rid in document order."""
    repeated = materialise(repeated_runs(scan(docs, length, anchor)), "repeated")
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)
    copied = repeated.where("copied").select("doc", first.alias("start"),
                                             (first + F.col("place").bitwiseAND(255) + length).alias("end"))
    open_ = repeated.where("NOT copied")
    sizes = materialise(open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "hot-anchors")
    salt = F.pmod(F.xxhash64("doc", "place"), F.ceil(F.col("n") / GROUP))
    runs = (open_.join(sizes, "anchor", "left")
            .select(F.when(F.col("n").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", salt)).alias("block"),
                    F.col("n").isNotNull().alias("hot"), "doc", "place"))
    compared = materialise(compare_blocks(fetch_runs(docs, runs, length), length), "compared")
    within = compared.where("window IS NULL").drop("window")
    # a window may stand in two runs of a document only if its place is the same, so places are counted, not rows
    alive = compared.where("window IS NOT NULL")
    place = F.struct("doc", "start")
    meet = alive.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    meet = materialise(meet.select("window", "first"), "windows")
    across = alive.join(meet, "window").where(F.struct("doc", "start") != F.col("first")).select("doc", "start", "end")
    return copied.unionByName(within).unionByName(across)


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__rid``, a long in document order.  Unique ids serve as
    they are; else the rows are sorted by id (nulls first) and text over ranges."""
    n, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if n == distinct:
        return docs.withColumn("__rid", F.col(id_col).cast("long"))
    keyed = docs.withColumn("__key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    order = [F.col(id_col).asc_nulls_first(), F.col("__key")]
    return materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("__rid", F.monotonically_increasing_id()).drop("__key"), "ordered")


def with_spans(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``docs`` (with __rid) and their removable spans as an array ``__spans``, null for none."""
    spans = removable_spans(docs.select(F.col("__rid").alias("rid"), "text"), length, anchor)
    lists = spans.groupBy(F.col("doc").alias("__rid")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    return docs.join(lists, "__rid", "left")


def cut(data: bytes, spans: list | None) -> tuple[bytes, int]:
    """(bytes that stay, maximal runs removed)."""
    if not spans:
        return data, 0
    _, start, end = unite(np.zeros(len(spans), np.int64), np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    kept = [data[a:b] for a, b in zip(np.append(0, end), np.append(start, len(data)))]
    return b"".join(kept), len(start)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    rows = ordered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                kept, n = cut(data, s)
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(rows, length, anchor).select("doc_id", "text", "__spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without repeated passages; a
    character that is cut in two goes whole.  ``n_chars`` is counted anew where
    text went."""
    rows = with_spans(ordered(docs, "doc_id", "text"), length, anchor)
    columns, counted = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars = b.column("text").to_pylist(), b.column("n_chars").to_pylist() if counted else []
            for i, s in enumerate(b.column("__spans").to_pylist()):
                if s:
                    texts[i] = cut(texts[i].encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore")
                    if counted:
                        chars[i] = len(texts[i])
            own = {"text": pa.array(texts, b.schema.field("text").type)}
            if counted:
                own["n_chars"] = pa.array(chars, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([own.get(c, b.column(c)) for c in columns], columns)

    return rows.select(*columns, "__spans").mapInArrow(run, docs.schema)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
