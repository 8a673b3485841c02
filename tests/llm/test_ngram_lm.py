"""Elias-Fano sequences, and scores against a brute-force model with the same smoothing."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibspark.llm import blocks as B
from calibspark.llm import ngram_lm as L
from calibspark.llm.elias_fano import EliasFano, select_in_word
from calibspark.llm.scratch import discard, stage_all
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs_frame, edge_rows, prose


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (10, 10), (1000, 10 ** 9), (1000, 50), (30000, 10 ** 12), (5, 0)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    got = EliasFano(EliasFano.build(values))
    if n:
        assert (got.access(np.arange(n)) == values).all()
    asked = np.concatenate([rng.integers(-2, top + 5, 500), values])
    place, equal = got.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_elias_fano_is_built_in_little_memory():
    """Low bits are cut from the values' bytes, not spread over wide integers."""
    values = np.cumsum(np.random.default_rng(3).integers(0, 1 << 21, 1 << 16))
    tracemalloc.start()
    data = EliasFano.build(values)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * len(values)
    assert (EliasFano(data).access(np.arange(len(values))) == values).all()


def test_select_in_word():
    rng = np.random.default_rng(4)
    words = np.concatenate([rng.integers(1, 1 << 64, 500, np.uint64), [np.uint64(1 << 63), ~np.uint64(0), np.uint64(1)]])
    for r in range(64):
        some = words[np.bitwise_count(words) > r]
        want = [[i for i in range(64) if int(w) >> i & 1][r] for w in some]
        assert select_in_word(some, np.full(len(some), r)).tolist() == want


def test_table_of_probabilities():
    q = np.arange(-1, 65536)
    assert (L.CHILD(q) == np.where(q >= 0, L.probability(q), 0.0)).all()
    assert (L.WEIGHT(q) == np.where(q >= 0, L.probability(q), 1.0)).all()


def test_shard_finds_its_nodes():
    rng = np.random.default_rng(1)
    width = 50
    codes = np.unique(rng.integers(7 * width, 400 * width, 3000))
    p, weight = rng.uniform(0.001, 1, len(codes)), (codes // width) % 7 / 10 + 0.1
    shard = L.Shard(L.Shard.build(codes, width, p, weight))
    asked = np.arange(0, 410 * width)
    node, place, q, w = shard.find(asked)
    there = np.isin(asked, codes)
    assert ((node >= 0) == there).all() and (codes[node[there]] == asked[there]).all()
    first = np.searchsorted(codes, codes // width * width)
    assert (place[there] == np.arange(len(codes)) - first).all()
    assert np.abs(np.log10(L.probability(q[there]) / p)).max() <= 0.5 / L.STEP + 1e-9
    known = np.isin(asked // width, codes // width)
    assert ((w >= 0) == known).all()


def test_pack():
    for a in (np.array([], np.int64), np.array([0, 5, 255]), np.array([-1, 70000]), np.array([1 << 40]), np.array([0.5]), np.array([True, False])):
        got = B.unpack(B.pack(a))[0]
        assert (got == a).all() and len(got) == len(a)


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_words_are_numbered_in_parts(spark, monkeypatch, part):
    """Few packed rows go between blocks and parts, not one for each symbol of a block."""
    monkeypatch.setattr(B, "PART", part)
    rng = np.random.default_rng(6)
    kinds = [b" ", b"", "\u00e9\u4e2d".encode(), b"\x00", *[b"w%d" % i for i in range(200)], b"x" * 5000]
    blocks = []
    for block in range(12):
        word = [kinds[i] for i in rng.permutation(len(kinds))[:60]]
        blocks.append((block << 32, word, [int(c) for c in rng.integers(0, 3, 60) ** 3 * (block + 1)], 60, sum(map(len, word))))
    blocks.append((99, [], [], 0, 0))
    frame = spark.createDataFrame(blocks, "block long, word array<binary>, count array<long>, n long, size long").repartition(3)
    got = B.word_numbers(frame, "words")
    total = Counter()
    for _, word, count, *_ in blocks:
        total.update(dict(zip(word, count)))
    known = {w: c for w, c in total.items() if c}
    rows = got.answers.collect()
    assert got.total == sum(known.values()) and got.kinds == len(known)
    assert len({(r.block, r.part) for r in rows}) == len(rows) and (part < 100 or len(rows) == 12)
    ids = {}
    for block, word, count, n, _ in blocks:
        found = [r.asDict() for r in rows if r.block == block]
        for w, i, c in zip(word, *(x.tolist() for x in B.word_ids(got.shift, n, found, -5))):
            assert c == total[w] and ids.setdefault(w, i) == i
    assert all((i == -5) == (w not in known) for w, i in ids.items())
    assert sorted(ids[w] for w in known) == list(range(len(known)))
    in_order = sorted(known, key=ids.get)
    assert (np.diff(B.count_class(np.array([known[w] for w in in_order]))) <= 0).all()
    discard(got.answers)


def test_words_of_nothing(spark):
    got = B.word_numbers(spark.createDataFrame([], "block long, word array<binary>, count array<long>, n long, size long"), "words")
    assert (got.total, got.kinds, got.answers.count()) == (0, 0, 0)


def test_tables_written_in_turns(spark):
    got = stage_all([spark.range(5), spark.range(5, 5), spark.range(3, 9)], "turns")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 3, 4, 4, 5, 6, 7, 8]
    discard(got)


def test_rows_that_travel_together(monkeypatch):
    monkeypatch.setattr(B, "BATCH", 10)
    rows = [{"x": bytes(n)} for n in (3, 0, 9, 25, 1)] + [{"x": None}]
    got = list(B.together(iter(rows), "x"))
    assert [len(g) for g in got] == [3, 1, 2] and [r for g in got for r in g] == rows


def tokens(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [" "]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def model(docs):
    """(probability of the i-th token of a list, counts of tokens, their total, kinds)."""
    counts = {n: Counter() for n in (1, 2, 3)}
    for i, text in docs:
        if not held(i):
            s = tokens(text)
            counts[1].update(s)
            for n in (2, 3):
                counts[n].update(zip(*[(["<s>"] + s)[k:] for k in range(n)]))
    total, kinds = sum(counts[1].values()), len(counts[1])
    stats = {}
    for n in (2, 3):
        sums, followers = Counter(), Counter()
        for g, c in counts[n].items():
            sums[g[:-1]] += c
            followers[g[:-1]] += 1
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        stats[n] = sums, followers, min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def quantised(p):
        return 10 ** (-min(round(-math.log10(p) * L.STEP), 65535) / L.STEP)

    def token(s, i):
        p = (counts[1][s[i]] + 1) / (total + kinds + 1)
        for n in (2, 3):
            sums, followers, less = stats[n]
            g = tuple(s[max(0, i - n + 1):i + 1])
            if len(g) < n or (n == 3 and not counts[2][g[:-1]]):
                break
            p = quantised(p) if n == 3 else p
            if sums[g[:-1]]:
                own = quantised((counts[n][g] - less) / sums[g[:-1]]) if counts[n][g] else 0
                p = own + quantised(less * followers[g[:-1]] / sums[g[:-1]]) * p
        return p

    return token, counts, total, kinds


def brute(docs):
    """{(doc_id, text): row} of the query's columns."""
    token, counts, total, kinds = model(docs)
    out = {}
    for i, text in docs:
        s = ["<s>"] + tokens(text)
        out[i, text] = (held(i), len(s) - 1, sum(counts[1][w] > 0 for w in s[1:]), total,
                        sum(math.log10((counts[1][w] + 1) / (total + kinds + 1)) for w in s[1:]), sum(math.log10(token(s, k)) for k in range(1, len(s))))
    return out


def check(rows, docs):
    want = brute(docs)
    by_id = defaultdict(list)
    for (i, text), row in want.items():
        by_id[i] += [row] * docs.count((i, text))
    assert len(rows) == len(docs)
    for i, expected in by_id.items():
        got = sorted(tuple(r)[1:] for r in rows if r.doc_id == i)
        assert len(got) == len(expected)
        for g, w in zip(got, sorted(expected)):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-6, rel=1e-9)


@pytest.mark.parametrize("part,block", [(1 << 20, 5 << 20), (200, 20_000)])
def test_query_equals_brute_force(spark, monkeypatch, part, block):
    """The second case has parts and blocks so small that contexts go over many parts."""
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "QUESTIONS", 2 * part)
    monkeypatch.setattr(B, "SAMPLE", 1024 if part > 1000 else 16)
    monkeypatch.setattr(B, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(L.op13_lm_scores(spark, SF_SMALL).collect(), docs)


def scores(spark, tmp_path, rows):
    docs_frame(spark, rows).withColumn("held", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    return L.op13_lm_scores(spark, str(tmp_path)).collect()


def test_edge_rows(spark, tmp_path):
    rows = edge_rows()
    check(scores(spark, tmp_path, rows), [(r[0], r[1]) for r in rows])


def test_nothing_to_learn_from(spark, tmp_path):
    ids = [i for i in range(60) if held(i)][:3]
    got = scores(spark, tmp_path, [(i, "a b c") for i in ids])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(4, 0, 0, 0.0, 0.0)] * 3


def test_probabilities_sum_to_one():
    """The model that the query is checked against is a distribution over all
    words, the end and one unknown word, up to quantisation."""
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(words, 30))) for i in range(40)]
    token = model(docs)[0]
    for context in (["<s>"], ["<s>", "w1"], ["<s>", "w1", "w2"], ["<s>", "zz", "w2"], ["<s>", "w2", "yy"], ["<s>", "zz", "yy"]):
        assert sum(token([*context, w], len(context)) for w in (*words, " ", "xx")) == pytest.approx(1, abs=2e-3)


def test_better_than_single_words_on_held_out_text(spark, tmp_path):
    """Texts drawn from a chain of word pairs: held-out texts score far better with contexts."""
    rng = np.random.default_rng(0)
    def walk():
        w, out = 0, []
        for _ in range(80):
            w = (w * 7 + rng.integers(0, 3)) % 101
            out.append(f"w{w}")
        return " ".join(out)
    got = [r for r in scores(spark, tmp_path, [(i, walk()) for i in range(300)]) if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert got and sum(r.base_score for r in got) / n < -1.9 and sum(r.score for r in got) / n > -0.62


def test_longer_order(spark):
    docs = docs_frame(spark, [(i, prose(i % 5, 60, 20)) for i in range(20)])
    three = {r.doc_id: r.score for r in L.score_documents(docs, F.col("doc_id") % 7 == 0).collect()}
    four = {r.doc_id: r.score for r in L.score_documents(docs, F.col("doc_id") % 7 == 0, order=4).collect()}
    assert all(four[i] > three[i] for i in three)
