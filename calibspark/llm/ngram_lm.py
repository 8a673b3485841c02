"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated n-gram model with absolute discounting,

    p(w | u v) = max(c(u v w) - D, 0) / c(u v .) + g(u v) * p(w | v),

down to ``p(w) = (c(w) + 1) / (N + V + 1)``; ``g`` is the discounted mass of a
context (1 for one that has no followers) and D comes from the counts of counts.

A node of level m is an m-gram.  Its parent is its first m - 1 tokens, and its
number among its parent's children is its last token's number *relative to
the context*: the place of the shorter m-gram (without the first token) among the
children of its own parent.  A level is sorted by (parent, number) and cut into
shards of at most ``SHARD`` nodes.  A shard has an Elias-Fano sequence of the
parents' first children (pointers), one of the children's numbers (each added to
the last value of the parent before, so the whole sequence increases), and
discounted probabilities and context weights quantised in steps of
``1 / STEP`` in the base-10 logarithm (error of a factor at most 10 ** (0.5 / STEP)).
A child is found by a successor search for its number, counted from where its
parent's children start.  A shard is one flat run of bytes, which a task maps
as arrays and reads in place.

Work: texts become blocks of token numbers (``blocks.py``).  For each level the
blocks' distinct training n-grams go, packed, to the part (a range of codes)
that they belong to, where they are counted and become a shard; then the blocks
ask the parts for their n-grams.  A part that is asked for much is copied as
often as its questions need, so neither a hot word nor a hot phrase gathers
in one task.  At the last level a block sends each token with its lower
probability (quantised the same way) and document, and gets sums of logarithms by
document.  Only one row per part (bounds, counts, first and last parent) reaches
the driver.  The model covers all training texts: nothing is pruned.

Defined results: a null or empty text is its end alone; a null id is the text
``''`` for the split; repeated rows are rows of their own and count in training
each time; without training texts every token has probability 1 / (0 + 0 + 1) and
scores are 0; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm import blocks as B
from calibspark.llm.elias_fano import EliasFano
from calibspark.llm.scratch import discard, stage, stage_all

#: Length of the longest n-gram.
ORDER = 3
#: Steps of a quantised logarithm.
STEP = 2048
#: Turns in which answers reach the blocks, and in which the last level is asked: less disk at a time.
TURNS = 2

TABLE = B.byte_table(b"\t\n\x0b\x0c\r")
#: The end of a text as a symbol; no word holds a space.
END = b" "


# ---------------------------------------------------------------- trie levels
def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) * STEP), 65535).astype(np.uint16)


def probability(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(float) / -STEP)


class Steps:
    """``probability`` by a table, made by the task that first asks; -1 gives ``none``."""

    def __init__(self, none: float):
        self.none, self.table = none, None

    def __call__(self, q: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.append(probability(np.arange(65536)), self.none)
        return self.table[q]


#: Of a child's quantised probability, and of its parent's weight.
CHILD, WEIGHT = Steps(0.0), Steps(1.0)


class Shard:
    """A run of consecutive nodes of a level."""

    @staticmethod
    def build(codes: np.ndarray, width: int, p: np.ndarray, weight: np.ndarray) -> bytes:
        """``codes`` sorted, parent * width + child; ``p`` of each node, ``weight`` of its parent."""
        parent, child = codes // width, codes % width
        new = np.flatnonzero(np.diff(parent, prepend=parent[0] - 1))
        first, span = parent[0], int(parent[-1] - parent[0]) + 1
        pointers = np.searchsorted(parent, first + np.arange(span + 1))
        last = np.cumsum(child[np.append(new[1:], len(codes)) - 1] + 1)
        before = np.concatenate([[0], last])[np.cumsum(np.diff(parent, prepend=parent[0]) > 0)]
        weights = np.zeros(span, np.uint16)
        weights[parent[new] - first] = quantise(weight[new])
        head = np.array([first, width, len(codes), span], np.int64).tobytes()
        return b"".join([head, EliasFano.build(pointers), EliasFano.build(before + child + 1), quantise(p).tobytes(), weights.tobytes()])

    def __init__(self, image: bytes | memoryview):
        image = memoryview(image)
        self.first, self.width, self.n, self.span = (int(x) for x in np.frombuffer(image, np.int64, 4))
        self.pointers = EliasFano(image[32:])
        at = 32 + self.pointers.size
        self.children = EliasFano(image[at:])
        at += self.children.size
        self.p = np.frombuffer(image, np.uint16, self.n, at)
        self.weights = np.frombuffer(image, np.uint16, self.span, at + 2 * self.n)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted codes: (node or -1, place among its parent's children
        here, quantised probability or -1, quantised weight of the parent or -1)."""
        node, place, p, weight = (np.full(len(codes), -1) for _ in range(4))
        parent = codes // self.width - self.first
        asked = np.flatnonzero((parent >= 0) & (parent < self.span))
        if len(asked):
            run = np.flatnonzero(np.diff(parent[asked], prepend=-1))
            ranges = np.searchsorted(run, np.arange(len(asked)), side="right") - 1
            own = parent[asked][run]
            start, end = self.pointers.access(own), self.pointers.access(own + 1)
            has = end > start
            origin = np.where(start > 0, self.children.access(np.maximum(start - 1, 0)), 0)
            weight[asked] = np.where(has, self.weights[own], -1)[ranges]
            asked, ranges = asked[has[ranges]], ranges[has[ranges]]
            at, equal = self.children.successor(origin[ranges] + codes[asked] % self.width + 1)
            equal &= at < end[ranges]
            hit = asked[equal]
            node[hit], place[hit], p[hit] = at[equal], at[equal] - start[ranges][equal], self.p[at[equal]]
        return node, place, p, weight


# ---------------------------------------------------------------- levels
@dataclass
class Level:
    """One level: ``images`` (part, image) of every part, empty for one
    without nodes, as written in ``nodes`` (packed), of which ``prepare`` makes the shard in the task that reads it; the parts' lower ``bounds``; by part the number of its first
    node and the children that its first parent has in earlier parts; ``edges``:
    the first and last parents of parts, sorted, and their quantised weights, since a
    part may be asked for a parent whose children are all in the parts beside it;
    ``size``: nodes, ``widest``: most children of a parent."""

    nodes: DataFrame
    images: DataFrame
    prepare: Callable
    bounds: np.ndarray
    base: dict
    earlier: dict
    edges: tuple[np.ndarray, np.ndarray]
    size: int
    widest: int


def parent_stats(parent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first node, total count, children) of each parent in sorted order."""
    new = np.flatnonzero(np.diff(parent, prepend=-1))
    return new, np.add.reduceat(counts, new), np.diff(np.append(new, len(parent)))


def build_level(blocks: DataFrame, codes_of: B.Codes, width: int, name: str) -> Level:
    """Count the blocks' training n-grams and build the level's shards.  A
    parent may have children in several parts: its totals are put together from
    the parts' first and last parents, one row per part."""
    bounds = B.part_bounds(blocks)

    def finish(part, codes, counts):
        parent = codes // width
        _, totals, kinds = parent_stats(parent, counts)
        return {"part": part, "n": len(codes), "once": int((counts == 1).sum()), "twice": int((counts == 2).sum()), "widest": int(kinds.max()),
                "first": parent[0], "first_total": totals[0], "first_kinds": kinds[0],
                "last": parent[-1], "last_total": totals[-1], "last_kinds": kinds[-1], "nodes": B.pack(np.diff(codes, prepend=0), counts)}

    edges = ("part", "n", "once", "twice", "widest", "first", "first_total", "first_kinds", "last", "last_total", "last_kinds")
    nodes = stage(B.counted_parts(blocks, codes_of, bounds, finish, ", ".join(f"{c} long" for c in edges) + ", nodes binary"), f"nodes-{name}")
    parts = nodes.select(*edges).orderBy("part").collect()
    once, twice = sum(r.once for r in parts), sum(r.twice for r in parts)
    less = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    # totals of the parents that go on from one part to the next
    whole: dict[int, list] = {}
    base, earlier, size = {}, {}, 0
    for r in parts:
        base[r.part], size = size, size + r.n
        earlier[r.part] = whole[r["first"]][1] if r["first"] in whole else 0
        for parent, total, kinds in {(r["first"], r.first_total, r.first_kinds), (r["last"], r.last_total, r.last_kinds)}:
            got = whole.setdefault(parent, [0, 0])
            got[0] += total
            got[1] += kinds
    edge_parents = {r.part: [(p, *whole[p]) for p in {r["first"], r["last"]}] for r in parts}
    widest = max([0, *(r.widest for r in parts), *(kinds for _, kinds in whole.values())])

    def prepare(part: int, packed: bytes) -> bytes:
        if not packed:
            return b""
        deltas, counts = B.unpack(packed)
        codes = np.cumsum(deltas)
        parent = codes // width
        new, totals, kinds = parent_stats(parent, counts)
        for p, total, number in edge_parents[part]:
            at = np.searchsorted(parent[new], p)
            totals[at], kinds[at] = total, number
        runs = np.diff(np.append(new, len(codes)))
        return Shard.build(codes, width, (counts - less) / np.repeat(totals, runs), np.repeat(less * kinds / totals, runs))

    empty = [(p, b"") for p in range(len(bounds)) if p not in base]
    images = nodes.select("part", F.col("nodes").alias("image"))
    images = images.union(nodes.sparkSession.createDataFrame(empty, images.schema))
    edge = sorted(whole)
    edges = np.array(edge, np.int64), quantise(np.array([less * whole[p][1] / whole[p][0] for p in edge], float)).astype(np.int64)
    return Level(nodes, images, prepare, bounds, base, earlier, edges, size, widest)


#: Sequence states between levels: the columns that every block of n-grams has.
DOCS = "block long, doc array<long>, held array<boolean>, length array<long>, known array<long>, base array<double>, part_score array<double>"
NGRAMS = DOCS + ", n long, sample array<long>, state binary"


def finder(level: Level, width: int) -> Callable:
    """What a part finds for sorted distinct codes: see ``Shard.find``, with
    node and relative numbers of the whole level; every code's parent weight."""
    base, earlier, (edge, edge_weight) = level.base, level.earlier, level.edges

    def find(image: pa.Buffer, part: int, codes: np.ndarray) -> tuple:
        if not image.size:
            node, place, p, weight = (np.full(len(codes), -1) for _ in range(4))
        else:
            shard = Shard(image)
            node, place, p, weight = shard.find(codes)
            there = node >= 0
            place = np.where(there & (codes // width == shard.first), place + earlier[part], place)
            node = np.where(there, node + base[part], -1)
        if len(edge):
            at = np.minimum(np.searchsorted(edge, codes // width), len(edge) - 1)
            weight = np.where((weight < 0) & (edge[at] == codes // width), edge_weight[at], weight)
        return node, place, p.astype(np.int32), weight.astype(np.int32)

    return find


def reply_nodes(node: np.ndarray, place: np.ndarray, p: np.ndarray, weight: np.ndarray) -> bytes:
    """A block's answer: the nodes of parents' first children rise, and so do the
    places below one parent."""
    there = node >= 0
    first, place = (node - place)[there], place[there]
    new = np.diff(first, prepend=-1) != 0
    return B.pack(np.packbits(there), np.diff(first, prepend=0), np.where(new, place, np.diff(place, prepend=0)), p[there], weight)


def places(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The places of an answer from their steps below each parent."""
    new = np.diff(first, prepend=-1) != 0
    total = np.cumsum(steps)
    return total - (total - steps)[new][np.cumsum(new) - 1]


def reply_scores(node: np.ndarray, place: np.ndarray, p: np.ndarray, weight: np.ndarray, lower: np.ndarray, doc: np.ndarray) -> bytes:
    """Sums of the tokens' logarithms by document."""
    logs = np.log10(interpolated(p, weight, CHILD(lower)))
    docs = np.flatnonzero(np.bincount(doc))
    return B.pack(docs, np.bincount(doc, logs)[docs])


def interpolated(p: np.ndarray, weight: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities from quantised ones (-1: none) and the lower ones."""
    return CHILD(p) + WEIGHT(weight) * lower


def answered(codes: np.ndarray, bounds: np.ndarray, found: list) -> list[np.ndarray]:
    """(node, number relative to the context, quantised probability: -1 for
    none; quantised weight) beside a block's sorted codes.  Every part answers."""
    by_part = {x["part"]: x["found"] for x in found or []}
    out = [np.full(len(codes), -1) for _ in range(4)]
    for part, lo, hi in B.slices(bounds, codes):
        there, first, steps, p, weight = B.unpack(by_part[part])
        at = lo + np.flatnonzero(np.unpackbits(there.astype(np.uint8), count=hi - lo))
        first = np.cumsum(first)
        place = places(first, steps)
        out[0][at], out[1][at], out[2][at], out[3][lo:hi] = first + place, place, p, weight
    return out


# ---------------------------------------------------------------- texts
def token_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(block, doc, held, length: per document; word, count: distinct tokens
    and their training counts; n, size: their number and bytes; seq: token numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, rows in B.in_blocks(batches, 2):
            texts = [t for b in rows for t in b.column(2).to_pylist()]
            held = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in rows]).astype(bool)
            words, first, _ = B.word_array(b" ".join(texts).translate(TABLE))
            number, distinct = B.numbered(words)
            ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
            seq = np.insert(number, ends, len(distinct))
            length = np.diff(ends, prepend=0) + 1
            yield {"block": block, "doc": [x for b in rows for x in b.column(0).to_pylist()], "held": held, "length": length,
                   "word": pa.concat_arrays([distinct.cast(pa.binary()), pa.array([END], pa.binary())]), "n": len(distinct) + 1,
                   "size": len(END) + sum(b.size for b in distinct.buffers()[2:]), "count": np.bincount(seq[~np.repeat(held, length)], minlength=len(distinct) + 1), "seq": B.pack(seq)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), held_out.alias("held"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return B.map_blocks(rows, run, "block long, doc array<long>, held array<boolean>, length array<long>, word array<binary>, "
                                   "size long, count array<long>, n long, seq binary")


def starts(length: np.ndarray) -> np.ndarray:
    """True at the first token of each document."""
    out = np.zeros(int(length.sum()), bool)
    out[np.cumsum(length) - length] = True
    return out


def per_document(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(length) - length)


def doc_columns(b: pa.RecordBatch, i: int) -> dict:
    return {c: b.column(c)[i].as_py() for c in ("block", "doc", "held", "length", "known", "base", "part_score")}


class Bigrams:
    """The state of a block before level 2: token numbers, their ids and
    counts.  Ids ``kinds`` and ``kinds + 1`` are a text's beginning and an unknown token."""

    def __init__(self, kinds: int, total: int):
        self.kinds, self.width, self.norm = kinds, kinds + 2, total + kinds + 1

    def tokens(self, b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each token's pair, its lower probability, whether it counts for training)."""
        seq, ids, c = B.unpack(b.column("state")[i].as_py())
        ids = np.cumsum(ids)
        length, held = B.numbers(b, "length", i), B.numbers(b, "held", i, bool)
        here = ids[seq]
        before = np.roll(here, 1)
        before[starts(length)] = self.kinds
        return before * self.width + here, ((c + 1) / self.norm)[seq], ~np.repeat(held, length)


class Longer:
    """The state of a block before a later level, in token order (-1: no code)."""

    def __init__(self, widest: int):
        self.width = widest + 1

    def tokens(self, b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, lower = B.unpack(b.column("state")[i].as_py())
        return codes, lower, training(codes, self.width, b, i)


def training(codes: np.ndarray, width: int, b: pa.RecordBatch, i: int) -> np.ndarray:
    """Tokens of training texts; the last number of a parent stands for n-grams that none has."""
    return ~np.repeat(B.numbers(b, "held", i, bool), B.numbers(b, "length", i)) & (codes % width != width - 1)


def trained_codes(kind) -> B.Codes:
    def codes_of(b, i):
        codes, _, train = kind.tokens(b, i)
        return np.unique(codes[train & (codes >= 0)], return_counts=True)
    return codes_of


def asked_codes(kind) -> B.Codes:
    def codes_of(b, i):
        codes = kind.tokens(b, i)[0]
        return (B.distinct(codes[codes >= 0]),)
    return codes_of


def bigram_state(blocks: DataFrame, shift: dict[int, np.ndarray], n_tokens: int, n_kinds: int) -> DataFrame:
    """Blocks with the answers of ``word_numbers`` (``found``), made ready for level 2."""
    unknown, norm = n_kinds + 1, n_tokens + n_kinds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                seq = B.unpack(b.column("seq")[i].as_py())[0]
                ids, c = B.word_ids(shift, b.column("n")[i].as_py(), b.column("found")[i].as_py(), unknown)
                ids, one, number = np.unique(ids, return_index=True, return_inverse=True)  # unknown tokens become one
                seq, c = number[seq], c[one]
                p = (c + 1) / norm
                length = B.numbers(b, "length", i)
                here = ids[seq]
                before = np.roll(here, 1)
                before[starts(length)] = n_kinds
                codes = B.distinct(before * (n_kinds + 2) + here)
                yield {**{c: b.column(c)[i].as_py() for c in ("block", "doc", "held", "length")}, "known": per_document((here != unknown) * 1, length),
                       "base": per_document(np.log10(p)[seq], length), "part_score": [0.0] * len(length), "n": len(codes),
                       "sample": B.sample_of(codes), "state": B.pack(seq, np.diff(ids, prepend=0), c)}

    return B.map_blocks(blocks.select("block", "doc", "held", "length", "n", "seq", "found"), run, NGRAMS)


def next_state(blocks: DataFrame, kind, level: Level, last: bool) -> DataFrame:
    """One token more, from blocks with their answers (``found``): the parent is
    the node of the tokens before, the child the token's number relative to
    its shorter context (``widest``: none).  A token without such a parent keeps
    its probability, which is added to its document's ``part_score`` at the last
    level.  The state is in token order, or at the ``last`` level sorted by code
    with each token's lower probability (quantised) and document."""
    bounds, widest = level.bounds, level.widest
    width = widest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                codes, lower, _ = kind.tokens(b, i)
                has = np.flatnonzero(codes >= 0)
                distinct, number = np.unique(codes[has], return_inverse=True)
                node, place = np.full(len(codes), -1), np.full(len(codes), -1)
                got = answered(distinct, bounds, b.column("found")[i].as_py())
                node[has], place[has] = got[0][number], got[1][number]
                lower[has] = interpolated(got[2][number], got[3][number], lower[has])
                length = B.numbers(b, "length", i)
                parent = np.where(starts(length), -1, np.roll(node, 1))
                codes = np.where(parent >= 0, parent * width + np.where(place >= 0, place, widest), -1)
                row = doc_columns(b, i)
                if last:
                    row["part_score"] = per_document(np.where(codes < 0, np.log10(lower), 0.0), length)
                    at = np.flatnonzero(codes >= 0)
                    at = at[np.argsort(codes[at])]
                    doc = np.repeat(np.arange(len(length)), length)[at]
                    state = B.pack(np.diff(codes[at], prepend=0), quantise(lower[at]), doc)
                    sample = codes[at]
                else:
                    state, sample = B.pack(codes, lower), B.distinct(codes[codes >= 0])
                yield {**row, "n": len(sample), "sample": B.sample_of(sample), "state": state}

    return B.map_blocks(blocks, run, NGRAMS)


def sorted_codes(width: int, trained: bool) -> B.Codes:
    """Codes of the last level's state: for counting those of training texts, else all with what goes with them."""
    def codes_of(b, i):
        deltas, lower, doc = B.unpack(b.column("state")[i].as_py())
        codes = np.cumsum(deltas)
        if not trained:
            return codes, lower, doc
        codes = codes[~B.numbers(b, "held", i, bool)[doc] & (codes % width != width - 1)]
        new = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[new], np.diff(np.append(new, len(codes)))
    return codes_of


def document_scores(blocks: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of each
    document, from blocks with the parts' sums (``found``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                row = doc_columns(b, i)
                score = np.array(row["part_score"], float)
                for x in sorted(b.column("found")[i].as_py() or [], key=lambda x: x["part"]):
                    docs, sums = B.unpack(x["found"])
                    score[docs] += sums
                yield {**row, "part_score": score}

    names = {"doc": "doc_id", "held": "held_out", "length": "n_tokens", "known": "n_known", "base": "base_score", "part_score": "score"}
    got = B.map_blocks(blocks, run, DOCS)
    return got.select(F.explode(F.arrays_zip(*names)).alias("s")).select(*[F.col(f"s.{a}").alias(b) for a, b in names.items()])


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the documents that aren't held out and score all of them; see
    the module's text.  ``order`` is 3 or more; ``base_score`` is that of single tokens."""
    if order < 3:
        raise ValueError("order must be 3 or more")
    texts = stage(token_blocks(docs, id_col, text_col, held_out), "token-blocks")
    words = B.word_numbers(texts, "tokens")
    total, kinds = words.total, words.kinds
    valued = B.with_answers(texts.select("block", "doc", "held", "length", "n", "seq"), words.answers)
    discard(words.answers)
    blocks = stage(bigram_state(valued, words.shift, total, kinds), "ngrams-2")
    discard(texts, valued)
    kind, parents, last = Bigrams(kinds, total), kinds + 2, False
    for m in range(2, order + 1):
        if parents * kind.width >= 1 << 63:
            raise OverflowError(f"level {m}: {parents} contexts with up to {kind.width} followers don't fit a 63-bit code")
        last = m == order
        level = build_level(blocks, sorted_codes(kind.width, True) if last else trained_codes(kind), kind.width, str(m))
        asked = blocks.select("block", "length", "held", "sample", "state")
        if last:
            answers = stage_all(B.ask_in_turns(asked, sorted_codes(kind.width, False), level.bounds, level.images, finder(level, kind.width),
                                                reply_scores, level.prepare, TURNS), "sums")
            discard(level.nodes)
            return document_scores(B.with_answers(blocks.drop("n", "sample", "state"), answers)).withColumn("train_tokens", F.lit(total).cast("long"))
        answers = B.ask(asked, asked_codes(kind), level.bounds, level.images, finder(level, kind.width), reply_nodes, level.prepare)
        found = B.with_answers(blocks.drop("n", "sample"), answers)
        discard(level.nodes)
        turns = [found.where(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == turn) for turn in range(TURNS)]
        longer = stage_all([next_state(turn, kind, level, m + 1 == order) for turn in turns], f"ngrams-{m + 1}")
        discard(blocks, found)
        blocks, kind, parents = longer, Longer(level.widest), level.size


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_documents(docs, held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
