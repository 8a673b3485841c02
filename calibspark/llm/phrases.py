"""Phrase collocation mining by direct-address tiling.

Words get ids in the order of their frequency.  A pair of ids is a cell of a
matrix that is cut into square tiles: frequency ranks crowd the pairs into few
tiles, which are counted by direct address (a dense bincount), while the pairs
of the other tiles are counted as sorted coordinates.  Frequent pairs are ranked
anew and get ids of their own; a frequent phrase of m + 1 words is then a pair of
frequent phrases of m words that overlap, so the same counting finds longer
phrases, up to ``LONGEST`` words.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``; A-Z are lower-cased.  Everything is per language.

Work: the texts are read once and kept as blocks of word numbers
(``blocks.py``).  At each length a task counts a block's pairs in tiles; its
distinct pairs go, packed, to the parts of the matrix that they belong to (runs of
tiles), where the slices of all blocks are added tile by tile.  The ids of the
frequent pairs go back to the blocks that asked.  No vocabulary is collected,
nor broadcast but by the planner's own size check.

Defined results: a null text is empty, a null language is ``und``; pieces
without two words have no phrases; repeated rows count each time; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibspark.llm import blocks as B
from calibspark.llm.scratch import discard, stage

LONGEST, MIN_COUNT, TOP = 4, 30, 2000
#: A phrase goes where a longer one that holds it has at least this share of its count, in hundredths.
ABSORB = 80
#: Bits of a tile's edge, tiles along an edge that may be dense, and pairs from which a tile is dense.
TILE, EDGE, DENSE = 9, 63, 1 << 15

TABLE = B.byte_table(b"\t", b".,;:!?\n\x0b\x0c\r")


# ---------------------------------------------------------------- counting
def cell_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of pairs of ids below 2**31: tile row, tile column, then row and column in the tile."""
    edge = (1 << TILE) - 1
    return ((left >> TILE) << 40) | ((right >> TILE) << 18) | ((left & edge) << TILE) | (right & edge)


def pair_of(code: Column) -> tuple[Column, Column]:
    """The two ids of a code."""
    tile, edge = (1 << 22) - 1, (1 << TILE) - 1
    left = F.shiftleft(F.shiftright(code, 40), TILE) + F.shiftright(code, TILE).bitwiseAND(edge)
    return left, F.shiftleft(F.shiftright(code, 18).bitwiseAND(tile), TILE) + code.bitwiseAND(edge)


def count_tiles(codes: np.ndarray, counts: np.ndarray | None = None, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their (summed) counts.  Tiles with ``dense``
    entries or more are counted by direct address, the others as sorted coordinates."""
    row, column = codes >> 40, (codes >> 18) & ((1 << 22) - 1)
    grid = (np.minimum(row, EDGE) << 6) | np.minimum(column, EDGE)
    filled = np.bincount(grid, minlength=(EDGE + 1) << 6)
    rest, found = np.ones(len(codes), bool), []
    for tile in np.flatnonzero(filled >= dense):
        if tile >> 6 == EDGE or tile & 63 == EDGE:  # the margin stands for all tiles beyond
            continue
        at = np.flatnonzero(grid == tile)
        rest[at] = False
        cells = 1 << (2 * TILE)  # weighted sums are doubles: exact up to 2**53
        table = np.bincount(codes[at] & (cells - 1), None if counts is None else counts[at], cells).astype(np.int64)
        used = np.flatnonzero(table)
        found.append(((int(tile) >> 6 << 40) | ((int(tile) & 63) << 18) | used, table[used]))
    sparse = codes[rest]
    found.append(B.added(sparse, np.ones(len(sparse), np.int64) if counts is None else counts[rest]))
    codes, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(codes)
    return codes[order], counts[order]


def word_blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(block, lang, word, count: arrays of the distinct words; n: their number; seq):
    ``seq`` has the word number at each place, -1 between pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, rows in B.in_blocks(batches, 1):
            texts: dict[str, list] = {}
            for b in rows:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    texts.setdefault(lang, []).append(text)
            langs, words, counts, seq, base = [], [], [], [], 0
            for lang, group in texts.items():
                got, _, line = B.word_array(b"\n".join(group).translate(TABLE))
                number, distinct = B.numbered(got)
                place = np.arange(len(number)) + np.cumsum(np.diff(line, prepend=line[:1]) > 0)
                out = np.full(place[-1] + 2 if len(place) else 0, -1)
                out[place] = number + base
                seq.append(out)
                langs += [lang] * len(distinct)
                words.append(distinct.cast(pa.binary()))
                counts.append(np.bincount(number, minlength=len(distinct)))
                base += len(distinct)
            yield {"block": block, "lang": langs, "word": pa.concat_arrays(words), "count": np.concatenate(counts), "n": base, "seq": B.pack(np.concatenate(seq))}

    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return B.map_blocks(rows, run, "block long, lang array<string>, word array<binary>, count array<long>, n long, seq binary")


def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs of neighbouring frequent symbols, their codes)."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, cell_codes(ids[at], ids[at + 1])


def block_pairs(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct pairs and their counts."""
    return count_tiles(places(B.unpack(b.column("seq")[i].as_py())[0])[1])


def id_row(block: int, ids: np.ndarray) -> dict:
    codes = count_tiles(places(ids)[1])[0]
    return {"block": block, "n": len(codes), "sample": B.sample_of(codes), "seq": B.pack(ids)}


IDS = "block long, n long, sample array<long>, seq binary"


def word_ids(blocks: DataFrame) -> DataFrame:
    """(block, n: distinct pairs, sample of them, seq: the id of the frequent
    word at each place, else -1) from word blocks with ``at`` and ``id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):  # the entry beyond the words is read for -1
                ids = B.scattered(b.column("n")[i].as_py() + 1, B.numbers(b, "at", i), B.numbers(b, "id", i), -1)
                yield id_row(b.column("block")[i].as_py(), ids[B.unpack(b.column("seq")[i].as_py())[0]])

    return B.map_blocks(blocks.select("block", "n", "seq", "at", "id"), run, IDS)


def longer_ids(blocks: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The same for phrases of one word more, from blocks with their pairs' ids (``found``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                here = B.unpack(b.column("seq")[i].as_py())[0]
                at, codes = places(here)
                distinct, number = np.unique(codes, return_inverse=True)
                ids = np.full(len(here), -1)
                ids[at] = B.answered(distinct, bounds, b.column("found")[i].as_py(), (-1,))[0][number]
                yield id_row(b.column("block")[i].as_py(), ids)

    return B.map_blocks(blocks.select("block", "seq", "found"), run, IDS)


def frequent_pairs(blocks: DataFrame, bounds: np.ndarray, min_count: int) -> DataFrame:
    """(code, a) of the pairs with ``min_count`` or more occurrences."""
    def finish(part, codes, counts):
        often = counts >= min_count
        return {"code": codes[often], "a": counts[often]}
    parts = B.counted_parts(blocks, block_pairs, bounds, finish, "code array<long>, a array<long>", count_tiles)
    return parts.select(F.explode(F.arrays_zip("code", "a")).alias("s")).select("s.code", "s.a")


def id_images(ids: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, image): the sorted codes of each part with their ids."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.maximum(np.searchsorted(bounds, b.column(0).to_numpy(), side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(part), *b.columns], ["part", "code", "id"])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("code")
        image = B.pack(part.column("code").to_numpy(), part.column("id").to_numpy())
        return pa.table({"part": part.column("part")[:1], "image": pa.array([image], pa.binary())})

    dealt = ids.select("code", "id").mapInArrow(deal, "part long, code long, id long")
    return dealt.groupBy("part").applyInArrow(run, "part long, image binary")


def unpacked_image(part: int, image: bytes) -> bytes:
    """Sorted codes, then their ids, as plain longs."""
    return np.concatenate(B.unpack(image)).astype(np.int64).tobytes()


def known_ids(image: pa.Buffer, part: int, codes: np.ndarray) -> tuple[np.ndarray]:
    known, ids = np.frombuffer(image, np.int64).reshape(2, -1)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return (np.where(known[at] == codes, ids[at], -1),)


# ---------------------------------------------------------------- phrases
def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                     min_count: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """(levels, totals): ``levels[m - 1]`` has the phrases of m words with
    ``min_count`` or more occurrences (id by falling count, lang, phrase, a,
    left, right: ids of the phrase without its last and first word, firsts and
    lasts: counts of its first and last 1..m words); ``totals`` (lang, n) the
    words of each language."""
    texts = stage(word_blocks(docs, text_col, lang_col), "word-blocks")
    words = B.symbols(texts, "lang", "word", "count")
    counted = stage(words.groupBy("lang", "word").agg(F.sum("count").alias("a")), "words")
    totals = stage(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    ids = checked(B.ranked(counted.where(F.col("a") >= min_count), [F.desc("a"), F.asc("lang"), F.asc("word")], "id", "word-ids"))
    discard(counted)
    level = ids.select("id", "lang", F.col("word").cast("string").alias("phrase"), "a", F.lit(None).cast("long").alias("left"),
                       F.lit(None).cast("long").alias("right"), F.array("a").alias("firsts"), F.array("a").alias("lasts"))
    levels = [stage(level, "phrases-1")]
    found = words.select("block", "place", "lang", "word").join(ids.select("lang", "word", "id"), ["lang", "word"])
    valued = B.with_values(texts.select("block", "n", "seq"), found.select("block", "place", "id"), "id")
    blocks = stage(word_ids(valued), "ids-1")
    discard(texts, valued)
    for m in range(2, longest + 1):
        bounds = B.part_bounds(blocks)
        ids = checked(B.ranked(frequent_pairs(blocks, bounds, min_count), [F.desc("a"), F.asc("code")], "id", f"pair-ids-{m}"))
        levels.append(stage(named(ids, levels[-1]), f"phrases-{m}"))
        if m < longest:
            answers = B.ask(blocks, lambda b, i: block_pairs(b, i)[:1], bounds, id_images(ids, bounds), known_ids, prepare=unpacked_image)
            answered = B.with_answers(blocks.select("block", "seq"), answers)
            longer = stage(longer_ids(answered, bounds), f"ids-{m}")
            discard(blocks, answered)
            blocks = longer
    discard(blocks)
    return levels, totals


def checked(ids: DataFrame) -> DataFrame:
    """A code holds two ids of 31 bits: more frequent phrases of one length are an error."""
    too_many = F.raise_error(F.lit("over 2**31 frequent phrases of one length: raise min_count")).cast("long")
    return ids.withColumn("id", F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(too_many))


def named(ids: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases from the pairs of overlapping shorter ones."""
    left, right = pair_of(F.col("code"))
    rows = ids.select("id", "a", left.alias("left"), right.alias("right"))
    first = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), "firsts")
    last = shorter.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), "lasts")
    rows = rows.join(first, "left").join(last, "right")
    return rows.select("id", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "left", "right",
                       F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"))


def scored(level: DataFrame, m: int) -> DataFrame:
    """Add the lowest-scoring cut's l, r and score; in decimals, so exact."""
    def cut(k):
        left, right = F.col("firsts")[k - 1], F.col("lasts")[m - k - 1]
        score = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div "
                       f"(cast(firsts[{k - 1}] as decimal(19,0)) + cast(lasts[{m - k - 1}] as decimal(19,0)))")
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    best = F.array_min(F.array(*[cut(k) for k in range(1, m)]))
    return level.withColumn("__cut", best).select("id", "lang", "phrase", "a", F.col("__cut.l").alias("l"), F.col("__cut.r").alias("r"),
                                                  F.col("__cut.score").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
                 absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score.  A phrase is absorbed by
    a longer one; of all longer ones those with one word more have the largest
    counts, so these decide."""
    levels, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count)
    kept = []
    for m in range(2, longest + 1):
        rows = scored(levels[m - 1], m)
        if m < longest:
            holders = levels[m].select(F.col("left").alias("id"), "a").union(levels[m].select(F.col("right").alias("id"), "a"))
            largest = holders.groupBy("id").agg(F.max("a").alias("longer"))
            share = lambda c, by: F.col(c).cast("decimal(19,0)") * by
            rows = (rows.join(largest, "id", "left")
                    .where(F.col("longer").isNull() | (share("longer", 100) < share("a", absorb))).drop("longer"))
        kept.append(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = reduce(DataFrame.union, kept).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(ws[i:i + {m - 1}], ' ') AS phrase, ws[i:i + {m - 1}] AS g "
        f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {m - 2})) AS i FROM pieces)" for m in range(1, LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, m, g, phrase, a, {k} AS k, g[1:{k}] AS p, g[{k + 1}:m] AS q FROM cand WHERE m > {k}"
                              for k in range(1, LONGEST))
    inner = " UNION ALL ".join(f"SELECT lang, g[{i}:{i + s - 1}] AS g, a FROM cand WHERE m = {m}"
                               for m in range(3, LONGEST + 1) for s in range(2, m) for i in range(1, m - s + 2))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
f AS (SELECT lang, m, g, any_value(phrase) AS phrase, count(*) AS a FROM ({grams}) GROUP BY lang, m, g),
cand AS (SELECT * FROM f WHERE m > 1 AND a >= {MIN_COUNT}),
tot AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS score
  FROM ({cuts}) c JOIN f x ON x.lang = c.lang AND x.g = c.p JOIN f y ON y.lang = c.lang AND y.g = c.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, g, max(a) AS longer FROM ({inner}) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, g) WHERE longer IS NULL OR 100 * longer < {ABSORB} * best.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN tot USING (lang)
WHERE rank <= {TOP}"""
