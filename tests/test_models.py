"""Model tests: Spark operators against plain-Python reference loops."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from calibspark.functions import stats as ST
from calibspark.operators.multiple_testing import bh_adjust
from calibspark.operators.sampling import quota_select


def greedy(rows, q):
    """The recipe's loop: arrival order, repo marked only on acceptance."""
    seen, counts, out = set(), {"java": 0, "python": 0}, []
    for pos, repo, lang in sorted(rows):
        if repo in seen or counts[lang] >= q:
            continue
        counts[lang] += 1
        seen.add(repo)
        out.append(pos)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_quota_equals_greedy(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 60)
    rows = [(p, f"r{rnd.randint(0, max(1, n // 3))}", rnd.choice(["java", "python"]))
            for p in rnd.sample(range(1000), n)]
    q = rnd.randint(1, 8)
    df = spark.createDataFrame(rows, "pos long, repo string, language string")
    got = sorted(r.pos for r in quota_select(df, q, ["java", "python"]).collect())
    assert got == sorted(greedy(rows, q))


def exact_p(b, c):
    n = b + c
    if n == 0:
        return 1.0
    tail = sum(Fraction(math.comb(n, i), 2 ** n) for i in range(min(b, c) + 1))
    return float(min(Fraction(1), 2 * tail))


def test_exact_p_against_fractions(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(40)] + [(2500, 2400), (0, 900)]
    got = [r[0] for r in spark.createDataFrame(rows, "b long, c long")
           .select(ST.mcnemar_exact_p(F.col("b"), F.col("c"))).collect()]
    for (b, c), g in zip(rows, got):
        assert g == pytest.approx(exact_p(b, c), rel=1e-9, abs=1e-300)


def bh_textbook(p):
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    adj = [0.0] * n
    running = 1.0
    for rank in range(n, 0, -1):
        i = order[rank - 1]
        running = min(running, p[i] * n / rank)
        adj[i] = running
    return adj


def test_bh_against_textbook(spark):
    rnd = random.Random(5)
    p = [rnd.random() ** 3 for _ in range(30)] + [0.2, 0.2]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    got = [r.p_adj for r in bh_adjust(df, family=[], tiebreak=["i"]).orderBy("i").collect()]
    assert got == pytest.approx(bh_textbook(p))


def test_pass_at_k_against_comb(spark):
    rows = [(n, c) for n in (1, 5, 20) for c in range(0, n + 1)]
    df = spark.createDataFrame(rows, "n int, c int")
    for k in (1, 5, 10):
        got = [r[0] for r in df.select(ST.pass_at_k(F.col("n"), F.col("c"), k)).collect()]
        for (n, c), g in zip(rows, got):
            want = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
            assert g == pytest.approx(want, abs=1e-12)


def test_range_buckets_are_balanced_and_ordered(spark):
    from calibspark.operators.stream_windows import range_buckets
    rnd = random.Random(11)
    xs = rnd.sample(range(10 ** 6), 8000)
    rows = range_buckets(spark.createDataFrame([(x,) for x in xs], "x long"), ["x"], "b", 40).collect()
    assert sorted(r.x for r in rows) == sorted(xs)
    by = {}
    for r in rows:
        by.setdefault(r.b, []).append(r.x)
    ends = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and len(by) > 30
    assert max(map(len, by.values())) < 3 * 8000 / 40


@pytest.mark.parametrize("n_buckets", [1, 5, 64])
def test_running_offset_on_skewed_keys(spark, n_buckets):
    from calibspark.operators.stream_windows import running_offset
    rnd = random.Random(n_buckets)
    # a third of the keys packed into a narrow range, the rest spread out
    keys = sorted(set(list(range(5000, 5700)) + rnd.sample(range(1_000_000), 1400)))
    vals = [rnd.randint(0, 50) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, vals)), "pos long, w long")
    got = {r.pos: r.offset for r in running_offset(df, "pos", "w", n_buckets, "offset").collect()}
    acc, want = 0, {}
    for k, v in zip(keys, vals):
        want[k] = acc
        acc += v
    assert got == want


def _h48(s):
    import hashlib
    return int(hashlib.md5(s.encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize("strict", [True, False])
def test_random_windows_sparse_positions_against_python(spark, strict):
    import re
    from calibspark.operators import sampling as S
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    # sparse, uneven positions (gaps), so the windowed ordinal path is used
    rows = [(d.doc_id * 3 + (d.doc_id % 7) * 1000, d.text, "m") for d in docs]
    corpus = spark.createDataFrame(rows, "pos long, text string, meta string")
    seqlen, n, seed = 40, 30, 5
    got = {r.sample_id: (r.doc_pos, r.start, r.raw_data)
           for r in S.random_windows(corpus, n, seqlen, seed=seed, strict=strict).collect()}
    by_ord = sorted(rows)
    toks = {p: re.findall(r"\s*\S+", t) for p, t, _ in rows}
    eligible = [p for p, _, _ in by_ord if (len(toks[p]) > seqlen if strict else len(toks[p]) >= seqlen)]
    for k in range(n):
        p = eligible[_h48(f"{seed}|{k}|doc") % len(eligible)]
        span = len(toks[p]) - seqlen
        st = 0 if span == 0 else _h48(f"{seed}|{k}|off") % span
        assert got[k] == (p, st, "".join(toks[p][st:st + seqlen]))


def test_random_windows_rare_documents_keep_every_draw(spark):
    from calibspark.operators import sampling as S
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("pos"), "text", F.lit("m").alias("meta"))
    n_tok = {r.pos: r.n for r in corpus.select("pos", F.size(F.split(F.trim("text"), r"\s+")).alias("n")).collect()}
    seqlen = sorted(n_tok.values())[-5]  # only a handful of documents qualify
    out = S.random_windows(corpus, 25, seqlen, seed=2, strict=False).collect()
    assert sorted(r.sample_id for r in out) == list(range(25))
    assert all(r.num_tokens == seqlen for r in out)


def test_random_windows_without_eligible_documents(spark):
    from calibspark.operators import sampling as S
    corpus = spark.createDataFrame([(i, "a b c", "m") for i in range(5)], "pos long, text string, meta string")
    assert S.random_windows(corpus, 7, 10).collect() == []


def test_duplicate_positions_are_an_error(spark):
    from calibspark.operators import sampling as S
    from calibspark.operators.ordinals import pos_ordinals
    for rows in ([(0,), (0,), (2,)], [(None,), (1,)]):
        with pytest.raises(Exception, match="unique"):
            pos_ordinals(spark.createDataFrame(rows, "pos long"))
    with pytest.raises(Exception, match="duplicate position"):
        S.eligible_index(spark.createDataFrame([(0, "a b"), (0, "c d")], "pos long, text string"), 1)


def test_index_is_used_again_and_read_by_block(spark):
    from calibspark.operators import sampling as S
    corpus = spark.createDataFrame([(i * 5000, "a b c d " * (i % 3), "m") for i in range(300)], "pos long, text string, meta string")
    index = S.eligible_index(corpus, 4)
    assert index.total == 100 and len(index.blocks) == 4
    again = sorted(map(tuple, S.random_windows(corpus, 5, 4, seed=1, index=index).collect()))
    assert again == sorted(map(tuple, S.random_windows(corpus, 5, 4, seed=1).collect()))
    plan = index.at_ranks(spark.createDataFrame([(0, 7), (1, 99)], "sample_id long, rank long"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [block" in plan and "IN" in plan


@pytest.mark.parametrize("b, c", [(0, 0), (0, 5), (3, 3), (1, 30), (40, 60), (700, 800), (1500, 1400), (30000, 30500)])
def test_exact_p_at_every_size(spark, b, c):
    from fractions import Fraction
    from math import comb
    from calibspark.functions.stats import mcnemar_exact_p
    got = spark.createDataFrame([(b, c)], "b long, c long").select(mcnemar_exact_p(F.col("b"), F.col("c"))).first()[0]
    n, term, total = b + c, 1, 0
    term = comb(n, min(b, c))
    for i in range(min(b, c), max(-1, min(b, c) - 3000), -1):
        total += term
        term = term * i // (n - i + 1)
    want = min(1.0, float(Fraction(2 * total, 2 ** n))) if n else 1.0
    assert abs(got - want) <= 1e-11 * want


@pytest.mark.parametrize("n_buckets", [1, 3, 16])
def test_bh_two_level_equals_window(spark, n_buckets):
    from calibspark.operators.multiple_testing import bh_adjust_two_level
    rnd = random.Random(n_buckets)
    rows = []
    for fam in range(4):
        for i in range(150 if fam else 400):
            p = rnd.choice([1.0, 0.5, 0.05]) if rnd.random() < 0.3 else rnd.random() ** 4
            rows.append((f"f{fam}", i, p))
    df = spark.createDataFrame(rows, "fam string, i int, p_value double")
    a = {(r.fam, r.i): r.p_adj for r in bh_adjust(df, family=["fam"], tiebreak=["i"]).collect()}
    b = {(r.fam, r.i): r.p_adj for r in bh_adjust_two_level(df, family=["fam"], n_buckets=n_buckets).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-12)
    for fam in ("f0", "f1"):
        ps = [p for f, _, p in rows if f == fam]
        want = bh_textbook(ps)
        got = [b[(fam, i)] for i in range(len(ps))]
        assert got == pytest.approx(want, rel=1e-12)


def greedy_k(rows, q, strata):
    seen, counts, out = set(), {s: 0 for s in strata}, []
    for pos, repo, lang in sorted(rows):
        if repo in seen or counts[lang] >= q:
            continue
        counts[lang] += 1
        seen.add(repo)
        out.append(pos)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_quota_three_strata_equals_greedy(spark, seed):
    rnd = random.Random(100 + seed)
    strata = ["java", "python", "go"]
    n = rnd.randint(10, 80)
    rows = [(p, f"r{rnd.randint(0, n // 4)}", rnd.choice(strata)) for p in rnd.sample(range(2000), n)]
    q = rnd.randint(1, 6)
    df = spark.createDataFrame(rows, "pos long, repo string, language string")
    got = sorted(r.pos for r in quota_select(df, q, strata).collect())
    assert got == sorted(greedy_k(rows, q, strata))


def _exact_tail(m, n):
    tot, c = 0, 1
    for i in range(0, m + 1):
        if i > 0:
            c = c * (n - i + 1) // i
        tot += c
    return float(Fraction(tot, 2 ** n))


def test_exact_p_large_counts(spark):
    rows = [(1200, 1500), (20000, 20100), (49000, 51000), (10**8, 10**8 + 20000), (10**9, 10**9 + 10**5)]
    got = {(r.b, r.c): r.p for r in spark.createDataFrame(rows, "b long, c long")
           .select("b", "c", ST.mcnemar_exact_p(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in rows[:3]:
        assert got[(b, c)] == pytest.approx(min(1.0, 2 * _exact_tail(min(b, c), b + c)), rel=1e-12)
    # huge counts: bounded work per row, close to the normal limit
    for b, c in rows[3:]:
        z = abs(c - b) / math.sqrt(b + c)
        normal = math.erfc(z / math.sqrt(2))
        assert 0 < got[(b, c)] <= 1 and got[(b, c)] == pytest.approx(normal, rel=1e-2)
