"""Arrival order: ordinals and stream offsets taken in the scan tasks."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from calibspark.operators import stream_windows as SW
from calibspark.operators.arrival import Arrival
from calibspark.session import scratch_path
from calibspark.sources.corpus import read_corpus
from tests.conftest import SF_SMALL


def fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(spark, rows, files=1):
    path = fresh(spark, "corpus")
    df = spark.createDataFrame(rows, "pos long, text string")
    df.repartitionByRange(files, "pos").sortWithinPartitions("pos").write.parquet(path)
    return spark.read.parquet(path)


def chunks(rows, seqlen, sep, limit=None):
    stream = sep.join(t or "" for _, t in sorted(rows))
    toks = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", stream)[:limit]
    return {(i // seqlen, len(toks[i:i + seqlen]), "".join(toks[i:i + seqlen])) for i in range(0, len(toks), seqlen)}


def corpus_rows(seed, n=80):
    rng = random.Random(seed)
    texts = ["", " ", "\n\t", "one", None, " lead", "trail  ", "a b c d e f g h i j k l"]
    return [(i * 3, rng.choice(texts + [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))])) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_the_joined_stream(spark, seed):
    rows = corpus_rows(seed)
    for seqlen, files in ((1, 3), (7, 1), (16, 5)):
        got = SW.encode_stream(stored(spark, rows, files), seqlen, "\n\n")
        assert {tuple(r) for r in got.collect()} == chunks(rows, seqlen, "\n\n")
    budget = SW.token_budget(stored(spark, rows, 2), 8, ndocs=50, n_chunks=5, sep=" ")
    assert {tuple(r) for r in budget.collect()} == chunks(sorted(rows)[:50], 8, " ", 40)


def test_unordered_corpus_is_laid_down_once(spark):
    rows = corpus_rows(9)
    random.Random(1).shuffle(rows)
    for corpus in (spark.createDataFrame(rows, "pos long, text string"), spark.createDataFrame(rows, "pos long, text string").repartition(4)):
        path = fresh(spark, "mixed")
        corpus.write.parquet(path)
        for c in (corpus, spark.read.parquet(path)):
            assert {tuple(r) for r in SW.encode_stream(c, 5).collect()} == chunks(rows, 5, "\n\n")


def test_windows_equal_the_joined_stream(spark):
    rows = corpus_rows(5)
    toks = re.findall(r"\s*\S+", "\n\n".join(t or "" for _, t in sorted(rows)))
    got = SW.stream_windows(stored(spark, rows, 4), 30, 9, seed=3).collect()
    assert len(got) == 30 and all(r.raw_data == "".join(toks[r.start:r.start + 9]) and r.num_tokens == 9 for r in got)


def test_many_blank_documents(spark):
    """A run of 10^5 texts without words is folded in its tasks."""
    path = fresh(spark, "blank")
    text = F.when(F.col("id") == 5, "first words here").when(F.col("id") == 100_050, "last").otherwise(" ")
    spark.range(0, 100_100, 1, 4).select(F.col("id").alias("pos"), text.alias("text")).write.parquet(path)
    got = sorted(map(tuple, SW.encode_stream(spark.read.parquet(path), 2).collect()))
    assert [r[:2] for r in got] == [(0, 2), (1, 2)]
    assert got[0][2].split() == ["first", "words"] and got[1][2].split() == ["here", "last"]
    assert len(got[1][2]) == len(" here") + 100_044 * 3 + 2 + len("last")
    pieces = SW.TokenStream(spark.read.parquet(path), "\n\n").pieces()
    assert pieces.count() < 100


def test_null_and_equal_positions_are_errors(spark):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="pos must"):
            Arrival(spark.createDataFrame(rows, "pos long, text string"), F.lit(1))




@pytest.mark.parametrize("fmt,comp", [("json", "gzip"), ("json", "none"), ("parquet", "snappy")])
def test_ordinals_follow_files_without_a_shuffle(spark, fmt, comp):
    path = fresh(spark, "shards")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.option("compression", comp).format(fmt).save(path)
    corpus = read_corpus(spark, path, pos_col=None, meta_col="doc_id", fmt=fmt, schema="doc_id long, text string")
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    order = [int(r.meta) for r in sorted(corpus.collect(), key=lambda r: r.pos)]
    assert order == sorted(order) and [r.pos for r in corpus.orderBy("pos").collect()] == list(range(docs.count()))


def test_ordinals_of_split_files(spark):
    """Plain JSON files that are read in several blocks."""
    path = fresh(spark, "blocks")
    spark.range(0, 5000, 1, 2).select(F.col("id").alias("n"), F.format_string("text %s", "id").alias("text")).write.json(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        corpus = read_corpus(spark, path, pos_col=None, meta_col="n", fmt="json", schema="n long, text string")
        got = corpus.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.pos for r in got] == list(range(5000)) and [int(r.meta) for r in got] == list(range(5000))


@pytest.mark.parametrize("files,shuffled", [(1, False), (7, False), (3, True)])
def test_batch_widths(spark, files, shuffled):
    """Batches that go over files, rows out of order, and no shuffle of arrays for rows in order."""
    from calibspark.operators.padding import with_batch_width
    rng = random.Random(files)
    rows = [(i, [1] * rng.randrange(9)) for i in range(203)]
    path = fresh(spark, "ids")
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    laid = df.repartition(files, "ids") if shuffled else df.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    laid.write.parquet(path)
    want = {b: max(len(x) for i, x in rows if i // 8 == b) for b in range(26)}
    out = with_batch_width(spark.read.parquet(path), "doc_id", "ids", 8)
    assert sorted((r.doc_id, r.ids, r.width) for r in out.collect()) == [(i, x, want[i // 8]) for i, x in rows]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_configurations_share_bits(spark):
    """Over 62 configurations: two longs, every comparison right."""
    from calibspark.operators.paired import Comparison, paired_contingency
    rng = random.Random(0)
    configs = [f"c{i:03d}" for i in range(70)]
    rows = [("m", p, c, rng.randrange(2)) for p in range(30) for c in configs]
    comparisons = [Comparison(a, b, first=rng.choice(["base", "other"])) for a, b in ((rng.sample(configs, 2)) for _ in range(25))]
    got = paired_contingency(spark.createDataFrame(rows, "model string, p int, q string, pass int"), ["p"], ["model"], "q", "pass", comparisons)
    by = {(p, c): o for _, p, c, o in rows}
    for r in got.collect():
        c = comparisons[r.cmp_idx]
        cells = [(by[p, c.first_config], by[p, c.second_config]) for p in range(30)]
        assert (r.n_pairs, r.a, r.b, r.c, r.d) == (30, *[cells.count(x) for x in ((0, 0), (0, 1), (1, 0), (1, 1))])
