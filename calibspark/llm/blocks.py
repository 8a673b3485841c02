"""Texts as blocks of small numbers.

A block is a few documents (about ``BLOCK`` bytes of text, one document at
least) whose tokens are numbers into the block's own list of distinct symbols.
What is counted or looked up over the whole corpus are the distinct symbols of
the blocks; the tokens themselves stay as packed arrays in one row per block.

Words are counted and given ids by Spark's aggregates and joins, or dealt by hash
into parts that number them (``word_numbers``).  Codes (63-bit
numbers that stand for pairs of ids) are dealt by value into parts of about
``PART`` entries, whose bounds come from a sample of the blocks' codes: a block
sends each part one packed slice, a task merges the slices of a part as they
stream in, and what a part found out goes back to the blocks the same way
(``ask``).  A part that is asked for much is copied as often as its questions
need, so a hot code doesn't gather in one task.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from calibspark.llm.scratch import discard, stage
from calibspark.llm.wordhash import mix, prefix_sums, span_hashes

#: Bytes of text in a block.
BLOCK = 3 << 20
#: Bytes of small rows that travel together.
BATCH = 1 << 20
#: Entries of a part, entries that one copy of a part answers, codes for one of the sample, codes looked up at a time.
PART, QUESTIONS, SAMPLE, LOOK = 1 << 20, 1 << 21, 1024, 1 << 17


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: integers in their smallest type, bytes of equal weight together."""
    small = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a):
            a = a.astype(np.promote_types(np.min_scalar_type(a.min()), np.min_scalar_type(a.max())))
            planes = a.view(np.uint8).reshape(len(a), -1)
            small.append((a.dtype.str, b"".join(np.ascontiguousarray(planes[:, k]) for k in range(a.dtype.itemsize))))
        else:
            small.append((a.dtype.str, a.tobytes()))
    raw = pickle.dumps(small, protocol=5)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<q", data)[0]
    out = []
    for kind, raw in pickle.loads(pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True)):
        dtype = np.dtype(kind)
        if dtype.kind in "iu":
            planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
            a = np.empty(planes.shape[::-1], np.uint8)
            for k, plane in enumerate(planes):
                a[:, k] = plane
            out.append(a.view(dtype).ravel().astype(np.int64))
        else:
            out.append(np.frombuffer(raw, dtype).copy())
    return out


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    codes = np.sort(codes)
    return codes[np.diff(codes, prepend=codes[:1] - 1) != 0]


def byte_table(spaces: bytes, ends: bytes = b"") -> bytes:
    """Translation of bytes: A-Z lower-cased, ``spaces`` to a space, ``ends`` to a line end."""
    table = bytearray(range(256))
    for i in range(65, 91):
        table[i] = i + 32
    for b in spaces:
        table[b] = 32
    for b in ends:
        table[b] = 10
    return bytes(table)


def word_array(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their first bytes, line of each) of translated bytes: runs of
    bytes that are neither space nor line end."""
    flat = np.frombuffer(data, np.uint8)
    line = flat == 10
    inside = ~(line | (flat == 32))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])])
    return words, start, np.searchsorted(np.flatnonzero(line), start)


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, distinct words), the frequent ones first, whose numbers pack well."""
    got = words.dictionary_encode()
    number = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(number, minlength=len(got.dictionary)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[number], got.dictionary.take(pa.array(order))


def in_blocks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block number, rows) with the texts (a binary column) of a task dealt
    into blocks; numbers are unique to the task's partition and place."""
    size = size or BLOCK
    number = TaskContext.get().partitionId() << 32
    held, taken = [], 0
    for b in batches:
        lengths = np.diff(np.frombuffer(b.column(text_at).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(text_at).offset)) if b.num_rows else []
        first = 0
        for i, n in enumerate(lengths):
            taken += int(n) + 1
            if taken >= size:
                yield number, [*held, b.slice(first, i + 1 - first)]
                number, held, taken, first = number + 1, [], 0, i + 1
        if first < b.num_rows:
            held.append(b.slice(first))
    if held:
        yield number, held


def map_blocks(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields rows as dicts of values and (numpy
    or Arrow) arrays, or lists of rows of values only, which travel together."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)

    def column(value, kind: pa.DataType) -> pa.Array:
        if isinstance(value, (np.ndarray, pa.Array)):
            value = pa.array(value, kind.value_type) if isinstance(value, np.ndarray) else value.cast(kind.value_type)
            return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(kind)
        return pa.array([value], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in fn(batches):
            if isinstance(row, list):
                columns = [pa.array([r[f.name] for r in row], f.type) for f in arrow]
            else:
                columns = [column(row[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, fields)


def together(rows: Iterator[dict], column: str) -> Iterator[list]:
    """Rows for ``map_blocks`` in lists of about ``BATCH`` bytes of a ``column``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[column] or b"")
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(df: DataFrame, order: list, out_col: str, name: str) -> DataFrame:
    """Add the 0-based rank in ``order``, which must be unique: sorted ranges,
    written with each row's place in its range, and a table of one row per range."""
    place = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = place.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    base, bases = 0, {}
    for r in sizes:
        bases[r["__part"]] = base
        base += r.n
    ranges = df.sparkSession.createDataFrame(list(bases.items()), "__part long, __base long")  # one row per range
    out = stage(place.withColumn("__part", part).join(F.broadcast(ranges), "__part")
                .withColumn(out_col, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__base"), name)
    discard(place)
    return out


def symbols(blocks: DataFrame, *columns: str) -> DataFrame:
    """(block, place, one value of each of the array ``columns``) of the blocks' distinct symbols."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return blocks.select("block", F.posexplode(zipped).alias("place", "s")).select("block", "place", *[F.col(f"s.{c}").alias(c) for c in columns])


def with_lists(blocks: DataFrame, rows: DataFrame, lists: list, name: str) -> DataFrame:
    """The blocks with ``lists`` (aggregates by block) of ``rows``.  They are
    written first, which frees the shuffles behind them; ``discard`` the result to delete them."""
    made = stage(rows.groupBy("block").agg(*lists), name)
    out = blocks.join(made, "block", "left")
    out._scratch = made._scratch
    return out


def with_values(blocks: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The blocks with arrays ``at`` (places of the symbols in ``found``) and
    ``columns`` (their values); null arrays where none was found."""
    return with_lists(blocks, found, [F.collect_list("place").alias("at"), *[F.collect_list(c).alias(c) for c in columns]], "values")


def numbers(batch: pa.RecordBatch, name: str, row: int, dtype=np.int64) -> np.ndarray:
    """The array in a row, without Python objects; null is empty."""
    value = batch.column(name)[row].values
    return np.zeros(0, dtype) if value is None else value.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def scattered(size: int, at: np.ndarray, values: np.ndarray, default) -> np.ndarray:
    out = np.full(size, default, np.result_type(values.dtype, type(default)) if len(values) else np.array(default).dtype)
    out[at] = values
    return out


# ---------------------------------------------------------------- words in parts
def binary_buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = words.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words_by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part of each, place of each: words in the order of their parts, by hash,
    first place first; their lengths; all their bytes)."""
    offsets, data = binary_buffers(words)
    data = data[offsets[0]:offsets[-1]]
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    part = (mix(span_hashes(prefix_sums(data), start, end) + (end - start).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    at = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    offsets, data = binary_buffers(words.take(pa.array(at)))
    return part[at], at, np.diff(offsets), data[offsets[0]:offsets[-1]]


def count_class(counts: np.ndarray) -> np.ndarray:
    """Classes that rise with the count (at least 1), four to each doubling."""
    double = np.frexp(counts)[1].astype(np.int64) - 1
    return 4 * double + ((4 * counts >> double) & 3)


@dataclass
class WordNumbers:
    """``answers`` (block, part, found): by part of words the packed places in the
    block, numbers in the part and counts; ``shift`` by part: what the numbers of
    a count's class lack of the words' ids; ``total``: sum of counts, ``kinds``:
    number of words with a count."""

    answers: DataFrame
    shift: dict[int, np.ndarray]
    total: int
    kinds: int



def word_ids(shift: dict[int, np.ndarray], size: int, found: list | None, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of a block's ``size`` symbols from its answers; ``unknown`` and 0 for those without a count."""
    ids, counts = np.full(size, unknown, np.int64), np.zeros(size, np.int64)
    for x in found or []:
        steps, number, c = unpack(x["found"])
        at = np.cumsum(steps)
        counts[at] = c
        known = c > 0
        ids[at[known]] = number[known] + shift[x["part"]][count_class(c[known])]
    return ids, counts


def word_numbers(blocks: DataFrame, name: str) -> WordNumbers:
    """Count the blocks' distinct symbols (``word``, ``count``; ``n`` of them, of
    ``size`` bytes) over all blocks and give those with a count ids from 0 on, by
    falling class of counts.  A block sends each part one packed slice of its
    words, the part numbers them by falling count and answers at once; only the
    sizes of a part's classes reach the driver, which tells where they begin."""
    n, size = blocks.agg(F.sum("n"), F.sum("size")).first()
    parts = max(1, -(-(n or 0) // PART), -(-(size or 0) // (16 * PART)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                block, counts = b.column("block")[i].as_py(), numbers(b, "count", i)
                part, at, length, data = words_by_part(b.column("word")[i].values, parts)
                first = np.concatenate([[0], np.cumsum(length)])
                new = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                for lo, hi in zip(new, [*new[1:], len(at)]):
                    packed = pack(np.diff(at[lo:hi], prepend=0), length[lo:hi], counts[at[lo:hi]], data[first[lo]:first[hi]].view("S1"))
                    yield {"part": int(part[lo]), "block": block, "slice": packed}

    def finish(part: int, names: list, slices_: list) -> Iterator[dict]:
        length = np.concatenate([s[1] for s in slices_])
        offsets = np.concatenate([[0], np.cumsum(length)])
        words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(s[3].tobytes() for s in slices_))])
        number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(number, np.concatenate([s[2] for s in slices_])).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        counts_of, number, lo = counts[number], rank[number], 0
        known = counts[counts > 0]
        yield {"block": None, "part": part, "found": None, "sizes": np.bincount(count_class(known)).tolist(), "tokens": int(known.sum())}
        for block, (steps, *_) in zip(names, slices_):
            hi = lo + len(steps)
            yield {"block": block, "part": part, "found": pack(steps, number[lo:hi], counts_of[lo:hi]), "sizes": None, "tokens": None}
            lo = hi

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, names, held = None, [], []
        for b in batches:
            for p, block, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if p != part and held:
                    yield from finish(part, names, held)
                    names, held = [], []
                part = p
                names.append(block)
                held.append(unpack(s.as_py()))
        if held:
            yield from finish(part, names, held)

    dealt = map_blocks(blocks.select("block", "word", "count"), lambda b: together(deal(b), "slice"), "part long, block long, slice binary")
    got = stage(map_blocks(dealt.repartition("part").sortWithinPartitions("part", "block"), lambda b: together(merge(b), "found"),
                           "block long, part long, found binary, sizes array<long>, tokens long"), name)
    sizes = got.where("block is null").select("part", "sizes", "tokens").orderBy("part").collect()  # one row per part
    by_class = np.zeros((max([0, *(len(r.sizes) for r in sizes)]), len(sizes)), np.int64)
    for k, r in enumerate(sizes):
        by_class[:len(r.sizes), k] = r.sizes
    down = by_class[::-1]  # frequent words first
    id_of = (np.cumsum(down) - down.ravel()).reshape(down.shape)
    shift = (id_of - (np.cumsum(down, axis=0) - down))[::-1]
    answers = got.where("block is not null").select("block", "part", "found")
    answers._scratch = got._scratch
    return WordNumbers(answers, {r["part"]: shift[:, k].copy() for k, r in enumerate(sizes)}, sum(r.tokens for r in sizes), int(by_class.sum()))


# ---------------------------------------------------------------- codes in parts
Codes = Callable[[pa.RecordBatch, int], tuple]


def sample_of(codes: np.ndarray) -> np.ndarray:
    """Evenly spaced codes of a block's sorted ones, one of ``SAMPLE``."""
    return codes[min(SAMPLE // 2, len(codes) - 1)::SAMPLE] if len(codes) else codes


def part_bounds(blocks: DataFrame) -> np.ndarray:
    """Lower bounds of the parts, from the columns ``n`` (codes) and ``sample`` of the blocks."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    if not total:
        return np.zeros(0, np.int64)
    parts = -(-total // PART)
    cuts = [i / parts for i in range(1, parts)]
    codes = blocks.select(F.explode("sample").alias("code"))
    inner = codes.agg(F.percentile_approx("code", cuts, max(10000, 10 * parts)).alias("c")).first().c if cuts else []
    return np.concatenate([[0], np.unique(np.array(inner, np.int64))])


def slices(bounds: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of sorted codes."""
    if not len(codes):
        return iter(())
    part = np.maximum(np.searchsorted(bounds, codes, side="right") - 1, 0)
    new = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(part[new].tolist(), new.tolist(), [*new[1:].tolist(), len(codes)])


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their summed counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    new = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[new], np.add.reduceat(counts, new) if len(new) else counts


def counted_parts(blocks: DataFrame, codes_of: Codes, bounds: np.ndarray, finish: Callable, schema: str, add: Callable = added) -> DataFrame:
    """One row per part with codes: ``finish(part, codes, counts)`` of its
    distinct codes and their counts over all blocks.  ``codes_of(batch, row)``
    gives a block's sorted codes and counts; a task merges the slices of a part
    while they stream in, with ``add``."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                codes, counts = codes_of(b, i)[:2]
                for part, lo, hi in slices(bounds, codes):
                    yield {"part": part, "slice": pack(np.diff(codes[lo:hi], prepend=0), counts[lo:hi])}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, held, size = None, [], 0

        def total():
            return add(*(np.concatenate(x) for x in zip(*held)))

        for b in batches:
            for p, s in zip(b.column(0).to_pylist(), b.column(1)):
                if p != part and held:
                    yield finish(part, *total())
                    held, size = [], 0
                part = p
                deltas, counts = unpack(s.as_py())
                held.append((np.cumsum(deltas), counts))
                size += len(counts)
                if size > 2 * PART:
                    held = [total()]
                    size = min(len(held[0][0]), PART)
        if held:
            yield finish(part, *total())

    dealt = map_blocks(blocks, lambda b: together(deal(b), "slice"), "part long, slice binary")
    return map_blocks(dealt.repartition("part").sortWithinPartitions("part"), merge, schema)


def ask(blocks: DataFrame, codes_of: Codes, bounds: np.ndarray, images: DataFrame, find: Callable, reply: Callable = pack,
        prepare: Callable | None = None) -> DataFrame:
    """``ask_in_turns`` in one turn."""
    return ask_in_turns(blocks, codes_of, bounds, images, find, reply, prepare, 1)[0]


def ask_in_turns(blocks: DataFrame, codes_of: Codes, bounds: np.ndarray, images: DataFrame, find: Callable, reply: Callable,
                 prepare: Callable | None, turns: int) -> list[DataFrame]:
    """(block, part, found) for each part's slice of a block's sorted codes.
    ``find(image, part, codes)`` gives arrays beside sorted distinct codes, those of
    all blocks that ask a copy of a part together; ``reply(*arrays, *others)``
    makes a block's answer from its share of them and the arrays that ``codes_of``
    gives beside its codes.  The blocks' column ``sample`` tells about how much each part is
    asked for, and so its copies.  ``images`` (part, image) has one row per part that knows
    something (``prepare(part, image)`` makes the real image); without one there is no answer.
    Each table returned has the answers of every ``turns``-th part: written one after
    another they need room for the questions of one turn only."""
    def volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(len(bounds), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                for s, lo, hi in slices(bounds, numbers(b, "sample", i)):
                    total[s] += (hi - lo) * SAMPLE
        used = np.flatnonzero(total)
        yield {"part": used, "size": total[used]}

    got = map_blocks(blocks.select("sample"), volumes, "part array<long>, size array<long>").select(F.explode(F.arrays_zip("part", "size")).alias("s"))
    copies = np.ones(len(bounds), np.int64)
    for r in got.groupBy("s.part").agg(F.sum("s.size").alias("size")).collect():  # one row per part
        copies[r["part"]] = -(-r["size"] // QUESTIONS)

    def deal(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                block, (codes, *arrays) = b.column("block")[i].as_py(), codes_of(b, i)
                for s, lo, hi in slices(bounds, codes):
                    if s % turns != turn:
                        continue
                    packed = pack(np.diff(codes[lo:hi], prepend=0), *(a[lo:hi] for a in arrays))
                    yield {"part": s, "copy": zlib.crc32(b"%d" % block) % int(copies[s]), "block": block, "asked": packed}

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for s, image in zip(b.column("part").to_pylist(), b.column("image")):
                for c in range(int(copies[s])):
                    yield {"part": s, "copy": c, "image": image.as_py()}

    def look_up(asked: pa.Table, images: pa.Table) -> pa.Table:
        found = []
        if images.num_rows and asked.num_rows:
            rows = [unpack(x.as_py()) for x in asked.column("asked")]
            codes = [np.cumsum(r.pop(0)) for r in rows]
            every, number = np.unique(np.concatenate(codes), return_inverse=True)
            image, part = images.column("image")[0].as_buffer(), images.column("part")[0].as_py()
            image = pa.py_buffer(prepare(part, image.to_pybytes())) if prepare else image
            got = [np.concatenate(x) for x in zip(*[find(image, part, every[i:i + LOOK]) for i in range(0, len(every), LOOK)])]
            at = np.cumsum([0, *map(len, codes)])
            found = [reply(*(g[number[lo:hi]] for g in got), *r) for lo, hi, r in zip(at, at[1:], rows)]
        else:
            asked = asked.slice(0, 0)
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "found": pa.array(found, pa.binary())})

    def answers(turn: int) -> DataFrame:
        questions = map_blocks(blocks.drop("sample"), lambda b: together(deal(b, turn), "asked"), "part long, copy long, block long, asked binary")
        known = map_blocks(images.where(F.col("part") % turns == turn).select("part", "image"), copy, "part long, copy long, image binary")
        keys = ["part", "copy"]
        return questions.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(look_up, "block long, part long, found binary")

    return [answers(turn) for turn in range(turns)]


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with their answers: ``found``, an array of (part, found)."""
    return with_lists(blocks, answers, [F.collect_list(F.struct("part", "found")).alias("found")], "answers")


def answered(codes: np.ndarray, bounds: np.ndarray, found: list | None, blank: tuple) -> list[np.ndarray]:
    """Arrays beside a block's sorted codes: its answers by part, ``blank`` where there is none."""
    by_part = {x["part"]: unpack(x["found"]) for x in found or []}
    pieces = [by_part.get(s) or [np.full(hi - lo, v) for v in blank] for s, lo, hi in slices(bounds, codes)]
    return [np.concatenate(x) for x in zip(*pieces)] if pieces else [np.zeros(0, np.array(v).dtype) for v in blank]
