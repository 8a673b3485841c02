"""Benchmark decontamination by SimHash of item-sized windows.

Windows of about an item's length slide over every whole text, an eighth of
their length at a time; each has a 64-bit SimHash of its word pairs.  Item
fingerprints are held by four 16-bit blocks: two fingerprints within ``RADIUS``
bits agree in some block to within RADIUS // 4 bits, so looking up every block
value within that distance finds all fingerprints within the radius.  A
candidate is verified by the exact weighted similarity (weighted Jaccard on
multisets) of five-word shingles, over the item-sized windows around it; a
shingle that several items share weighs 1 / their number, and a word pair has
the least weight of the shingles that cover it.

A text's shingles are first looked up among those of the items.  Fingerprints
are made only where the shingles found around a window weigh enough for an
item of its size; elsewhere the verification couldn't accept any, so this
loses nothing.

The items are a stated query set.  They are taken in blocks of at most
``ITEM_BLOCK``, each sent to the executors once, and documents are scanned once
for each block; documents are never shuffled.

Window sizes stand for item lengths within ``RATIO`` of each other.  The
guarantee is on fingerprints; how often a window of similarity 0.8 or more has
its fingerprint within the radius is measured in the tests.

Defined results: a null or empty text matches nothing; items that are null or
shorter than a shingle (five words) never match; a document shorter than an
item is one window; repeated documents match alike; of equal pairs of ids the
best match is returned; empty tables give an empty result; columns other than
ids and texts are not read (and are kept as they are by ``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.wordhash import shingles, text_groups, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
PAIR = 2
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
RATIO, STRIDE = 1.12, 8
ITEM_BLOCK = 20_000
#: Words of a text that are looked at together.
PIECE = 100_000
#: Weight of a word pair that no item shares, in whole numbers so that sums are exact.
UNIT = 1 << 16


def bit_sums(features: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Prefix sums of the weights by the features' bits (64 columns) and in all."""
    out = np.zeros((len(features) + 1, 65), np.int64)
    out[1:, :64] = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    out[1:, 64] = 1
    out[1:] *= weight[:, None]
    return np.cumsum(out, axis=0, out=out)


def fingerprints(sums: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of n features from each start: a bit is set if features of over half their weight have it."""
    held = sums[start + n] - sums[start]
    return np.packbits(2 * held[:, :64] > held[:, 64:], axis=1).view(np.uint64).ravel()


def pair_weights(shingle_weight: np.ndarray) -> np.ndarray:
    """Whole-number weight of each word pair: the least of the shingles that cover it."""
    own = np.maximum(1, np.rint(shingle_weight * UNIT)).astype(np.int64)
    side = np.full(SHINGLE - PAIR, UNIT, np.int64)
    own = np.concatenate([side, own, side])
    return np.lib.stride_tricks.sliding_window_view(own, SHINGLE - PAIR + 1).min(axis=1)


def near_values(bits: int, distance: int) -> np.ndarray:
    """Masks of at most ``distance`` set bits."""
    return np.array([sum(1 << b for b in c) for d in range(distance + 1) for c in combinations(range(bits), d)], np.uint64)


class ItemIndex:
    """Items by window size, with the block table of their fingerprints, and
    the items' distinct shingles with their weights, sorted by hash."""

    def __init__(self, ids: list, texts: list, radius: int = RADIUS):
        self.radius = radius
        found = []  # (id, words, word hashes, distinct shingles, counts)
        for i, t in zip(ids, texts):
            w, _ = word_hashes([t])
            if len(w) >= SHINGLE:
                found.append((i, len(w), w, *np.unique(shingles(w, SHINGLE), return_counts=True)))
        found.sort(key=lambda x: x[1])
        self.grams, shared = np.unique(np.concatenate([x[3] for x in found] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.weight = 1 / shared
        self.items = []  # (id, words, numbers of its distinct shingles, their counts, weight of all)
        for i, n, _, grams, counts in found:
            numbers = np.searchsorted(self.grams, grams)
            self.items.append((i, n, numbers, counts, float((self.weight[numbers] * counts).sum())))
        masks = near_values(BLOCK_BITS, radius // BLOCKS)
        self.sizes = []  # (window words, first item, fingerprints, per block: offsets and item numbers by block value)
        self.needs = []  # per size: (longest item's words, least weight that a window must share)
        first = 0
        while first < len(found):
            last = first
            while last < len(found) and found[last][1] <= found[first][1] * RATIO:
                last += 1
            size = (found[first][1] + found[last - 1][1]) // 2
            prints = []
            for _, _, w, _, _ in found[first:last]:
                f = shingles(w, PAIR)
                _, weight = self.look_up(shingles(w, SHINGLE))
                prints.append(fingerprints(bit_sums(f, pair_weights(weight)), np.zeros(1, np.int64), np.full(1, len(f)))[0])
            prints = np.array(prints, np.uint64)
            tables = []
            for b in range(BLOCKS):
                part = prints >> np.uint64(b * BLOCK_BITS) & np.uint64((1 << BLOCK_BITS) - 1)
                near = (part[:, None] ^ masks[None, :]).ravel().astype(np.uint16)
                offset = np.zeros((1 << BLOCK_BITS) + 1, np.int64)
                np.cumsum(np.bincount(near, minlength=1 << BLOCK_BITS), out=offset[1:])
                tables.append((offset, (np.argsort(near, kind="stable") // len(masks)).astype(np.int32)))
            self.sizes.append((size, first, prints, tables))
            self.needs.append((found[last - 1][1], SIMILARITY * min(x[4] for x in self.items[first:last]) - 1e-6))
            first = last

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each shingle among the items', -1 for none; its weight, 1 for none)."""
        if not len(self.grams):
            return np.full(len(grams), -1), np.ones(len(grams))
        number = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        number[self.grams[number] != grams] = -1
        return number, np.where(number >= 0, self.weight[number], 1.0)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of the size class) of all fingerprints within the radius."""
        _, _, items, tables = self.sizes[size]
        windows, found = [], []
        for b, (offset, who) in enumerate(tables):
            value = (prints >> np.uint64(b * BLOCK_BITS) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = offset[value + 1] - offset[value]
            at = np.flatnonzero(n)
            n = n[at]
            if not len(at):
                continue
            window = np.repeat(at, n)
            nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            item = who[offset[value[window]] + nth]
            near = np.bitwise_count(prints[window] ^ items[item]) <= self.radius
            windows.append(window[near])
            found.append(item[near])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(windows), np.concatenate(found)

    def verify(self, number: np.ndarray, weight: np.ndarray, n_words: int, item: int) -> tuple[float, int]:
        """(similarity, start) of the best item-sized window of a span of
        ``n_words``, given its shingles' numbers and weights: weighted Jaccard
        of multisets for each start.  An occurrence counts for the starts from
        which it is among the first of its shingle, as many as the item has."""
        _, n, mine, counts, total = self.items[item]
        width = min(n, n_words) - SHINGLE + 1
        slot = np.minimum(np.searchsorted(mine, number), len(mine) - 1)
        at = np.flatnonzero(mine[slot] == number)
        starts = len(number) - width + 1
        if not len(at):
            return 0.0, 0
        at = at[np.argsort(slot[at], kind="stable")]
        of = slot[at]
        before = np.arange(len(at)) - counts[of]
        held = np.maximum(before, 0)
        same = (before >= 0) & (of[held] == of)
        first = np.maximum(np.where(same, at[held] + 1, 0), at - width + 1)
        last = np.minimum(at, starts - 1)
        ok = first <= last
        low = np.zeros(starts + 1)
        np.add.at(low, first[ok], weight[at[ok]])
        np.subtract.at(low, last[ok] + 1, weight[at[ok]])
        low = np.cumsum(low)[:-1]
        mass = np.concatenate([[0.0], np.cumsum(weight)])
        score = np.round(low / (mass[width:width + starts] - mass[:starts] + total - low), 12)
        best = int(np.argmax(score))
        return float(score[best]), best

    def search(self, texts: list) -> Iterator[tuple[int, object, int, int, float]]:
        """(row, item id, start word, words, similarity) of the best verified match of each row and item."""
        least = min((need for _, need in self.needs), default=0.0)
        for first, last in text_groups(texts):
            words, per_text = word_hashes(texts[first:last])
            if len(words) < SHINGLE or not self.items:
                continue
            ends = np.cumsum(per_text)
            number, weight = self.look_up(shingles(words, SHINGLE))
            for k in range(1, SHINGLE):  # shingles over the end of a text
                over = ends - k
                over = over[(over >= 0) & (over < len(number))]
                number[over], weight[over] = -1, 1.0
            mass = np.zeros(len(words) + 1)  # weight of the shingles found before each word
            np.cumsum(np.where(number >= 0, weight, 0.0), out=mass[1:len(number) + 1])
            mass[len(number) + 1:] = mass[len(number)]
            n = np.where(mass[ends] - mass[ends - per_text] >= least, per_text, 0)
            if n.any():
                pairs = pair_weights(weight)
                for piece in self._pieces(ends - per_text, n):
                    yield from self._search(words, number, weight, pairs, mass, first, ends - per_text, per_text, piece)

    def _pieces(self, begin: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """Groups of (text, first word, words): long texts are cut with an overlap of two of the longest items."""
        overlap = 2 * self.items[-1][1] if self.items else 0
        held, rows = 0, []
        for t in np.flatnonzero(n >= SHINGLE):
            for at in range(0, max(1, n[t] - overlap), PIECE):
                size = min(PIECE + overlap, n[t] - at)
                rows.append((t, begin[t] + at, size))
                held += size
                if held >= PIECE:
                    yield np.array(rows)
                    held, rows = 0, []
        if rows:
            yield np.array(rows)

    def _search(self, words, number, weight, pairs, mass, first_row, begin, per_text,
                piece) -> Iterator[tuple[int, object, int, int, float]]:
        text, at, n = piece.T
        best: dict = {}
        for c, (size, first_item, _, _) in enumerate(self.sizes):
            longest, need = self.needs[c]
            stride = max(1, size // STRIDE)
            whole = np.maximum(n - size, 0) // stride + 1
            owner = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            # strided windows and the one that ends with the piece; a short piece is one window
            start = np.concatenate([at[owner] + nth * stride, at + np.maximum(n - size, 0)])
            owner = np.concatenate([owner, np.arange(len(n))])
            lo, hi = self.around(start, longest, begin[text[owner]], per_text[text[owner]])
            live = mass[hi] - mass[lo] >= need
            start, owner = start[live], owner[live]
            if not len(start):
                continue
            width = np.minimum(size, n[owner])
            window, item = self.candidates(self.window_prints(words, pairs, start, width), c)
            for w, i in np.unique(np.stack([window, item + first_item], axis=1), axis=0).tolist():
                t = int(text[owner[w]])
                lo, hi = self.around(start[w], self.items[i][1], begin[t], per_text[t])
                score, place = self.verify(number[lo:hi - SHINGLE + 1], weight[lo:hi - SHINGLE + 1], int(hi - lo), i)
                place += int(lo - begin[t])
                if score >= SIMILARITY and ((t, i) not in best or (score, -place) > (best[t, i][0], -best[t, i][1])):
                    best[t, i] = (score, place)
        for (t, i), (score, place) in sorted(best.items()):
            yield first_row + t, self.items[i][0], place, min(self.items[i][1], int(per_text[t])), score

    @staticmethod
    def around(start, n: int, begin, per_text):
        """First and last word (exclusive) of the span in which a candidate is verified."""
        return np.maximum(begin, start - n // 2), np.minimum(begin + per_text, start + n + n // 2 + 1)

    @staticmethod
    def window_prints(words, pairs, start, width) -> np.ndarray:
        """Fingerprints of windows, of at least two words; only the words that they cover are summed."""
        lo, hi = start.min(), (start + width).max()
        edge = np.zeros(hi - lo + 1, np.int64)
        np.add.at(edge, start - lo, 1)
        np.subtract.at(edge, start + width - PAIR + 1 - lo, 1)
        covered = np.flatnonzero(np.cumsum(edge)[:hi - lo - PAIR + 1])
        features = shingles(words[lo:hi], PAIR)[covered]
        sums = bit_sums(features, pairs[lo:hi][covered])
        return fingerprints(sums, np.searchsorted(covered, start - lo), width - PAIR + 1)


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the items, at most about ``block`` at a time."""
    rows = benchmark.selectExpr("CAST(item_id AS long) AS item_id", "text").where("text IS NOT NULL").distinct()
    n = rows.count()
    parts = -(-n // block)
    for p in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield [r[0] for r in got], [r[1] for r in got]


def index_of(held: dict, radius: int) -> ItemIndex:
    """The index of a broadcast block of items, built once per worker process: the value stays there between tasks."""
    if "index" not in held:
        held["index"] = ItemIndex(held["ids"], held["texts"], radius)
    return held["index"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): one row per document and item that it holds."""
    spark, found = docs.sparkSession, None
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, item_id long, start_word long, n_words long, similarity double"
    for ids, texts in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast({"ids": ids, "texts": texts})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, radius)
            for b in batches:
                rows = list(index.search(b.column("text").to_pylist()))
                if rows:
                    row, item, start, n, score = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(score, pa.float64())],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.start_word", "b.n_words", F.round(-F.col("b.s"), 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for ids, texts in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast({"ids": ids, "texts": texts})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value, radius)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for row, *_ in index.search(b.column(text_col).to_pylist()):
                    clean[row] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
