"""Property tests on the sampling and statistics operators."""

from pyspark.sql import functions as F

from calibspark.functions import tokens as TK
from calibspark.operators import sampling as S
from calibspark.operators.split import split_train_val
from calibspark.plans import reports as R
from calibspark.sources import fixtures as FX
from calibspark.sources.corpus import document_corpus
from tests.conftest import SF_MID, SF_SMALL


def test_random_windows_shape(spark):
    corpus = document_corpus(spark, SF_MID)
    w = S.random_windows(corpus, 50, 32, seed=7).collect()
    n_tok = {r.doc_id: r.n for r in spark.read.parquet(f"{SF_MID}/documents.parquet")
             .select("doc_id", TK.token_count(F.col("text")).alias("n")).collect()}
    assert len(w) == 50
    for r in w:
        assert r.num_tokens == 32
        assert 0 <= r.start <= n_tok[r.doc_pos] - 32 - 1


def test_quota_properties(spark):
    s = S.quota_sample(FX.code_corpus(spark, SF_MID), 40, 64).collect()
    assert len({r.repo for r in s}) == len(s)
    for lang in ("java", "python"):
        assert sum(r.language == lang for r in s) <= 20
    assert all(r.num_tokens == 64 for r in s)


def test_split_properties(spark):
    sample = S.quota_sample(FX.code_corpus(spark, SF_MID), 40, 64)
    rows = split_train_val(sample, 8, seed=3).collect()
    val = {r.sample_id for r in rows if r.split == "val"}
    train = {r.sample_id for r in rows if r.split == "train"}
    assert len(val) == 8 and not (val & train) and len(val | train) == 40


def test_report_invariants(spark):
    rep = R.paired_report(FX.attempts_with_pass(spark, SF_SMALL), R.RQ1).collect()
    for r in rep:
        assert r.p_adj >= r.p_value - 1e-15
    flipped = R.ReportSpec(R.RQ1.models, R.RQ1.languages,
                           [R.Comparison(c.base, c.other, first="base") for c in R.RQ1.comparisons],
                           R.RQ1.family, R.RQ1.sort)
    rep2 = {r.row_id: r for r in R.paired_report(FX.attempts_with_pass(spark, SF_SMALL), flipped).collect()}
    for r in rep:
        o = rep2[r.row_id]
        assert (r.b, r.c) == (o.c, o.b)
        assert abs(r.p_value - o.p_value) < 1e-12


def test_partitioning_independence(spark):
    base = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        q = S.quota_sample(FX.code_corpus(spark, SF_SMALL), 20, 32).select("doc_pos", "raw_data")
        w = S.random_windows(document_corpus(spark, SF_SMALL), 10, 16, seed=1).select("sample_id", "raw_data")
        out.append((sorted(map(tuple, q.collect())), sorted(map(tuple, w.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", base)
    assert out[0] == out[1] == out[2]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "pos long, text string, meta string")
    assert S.random_windows(empty, 5, 8).count() == 0
    assert S.quota_sample(empty, 4, 8).count() == 0
    sh = S.shortage(S.quota_sample(empty, 4, 8), 2, ["java", "python"]).collect()
    assert sorted((r.language, r.missing) for r in sh) == [("java", 2), ("python", 2)]


def test_progressive_scan_equals_single_pass(spark):
    code = FX.code_corpus(spark, SF_MID)
    qa = FX.qa_corpus(spark, SF_MID)
    one = sorted(map(tuple, S.quota_sample(code, 40, 64).select("doc_pos", "raw_data").collect()))
    many = sorted(map(tuple, S.quota_sample(code, 40, 64, first_span=7, growth=2)
                      .select("doc_pos", "raw_data").collect()))
    assert one == many
    h1 = sorted(r.doc_pos for r in S.qa_head(qa, 20, 64).collect())
    h2 = sorted(r.doc_pos for r in S.qa_head(qa, 20, 64, first_span=5, growth=3).collect())
    assert h1 == h2 and len(h1) == 20


def _att(spark, rows):
    return spark.createDataFrame(rows, "model string, language string, problem string, attempt int, "
                                       "quantization string, pass int")


def test_pairing_rejects_duplicates_and_unpaired(spark):
    import pytest
    from calibspark.operators.paired import Comparison, paired_contingency
    ok = [("m", "py", "P1", 0, "a", 1), ("m", "py", "P1", 0, "b", 0)]
    cmp = [Comparison("a", "b")]
    rows = paired_contingency(_att(spark, ok), ["problem", "attempt"], ["model", "language"],
                              "quantization", "pass", cmp).collect()
    assert (rows[0].n_pairs, rows[0].b, rows[0].c) == (1, 0, 1)
    with pytest.raises(Exception, match="duplicate"):
        paired_contingency(_att(spark, ok + [("m", "py", "P1", 0, "a", 0)]), ["problem", "attempt"],
                           ["model", "language"], "quantization", "pass", cmp).collect()
    with pytest.raises(Exception, match="unpaired"):
        paired_contingency(_att(spark, ok + [("m", "py", "P2", 0, "a", 0)]), ["problem", "attempt"],
                           ["model", "language"], "quantization", "pass", cmp).collect()
    dropped = paired_contingency(_att(spark, ok + [("m", "py", "P2", 0, "a", 0)]), ["problem", "attempt"],
                                 ["model", "language"], "quantization", "pass", cmp, on_unpaired="drop").collect()
    assert dropped[0].n_pairs == 1


def test_key_fetch_join_path_equals_inline_path(spark, monkeypatch):
    from calibspark.operators import bounded
    corpus = document_corpus(spark, SF_SMALL)
    a = sorted(map(tuple, S.random_windows(corpus, 12, 16, seed=4).collect()))
    q1 = sorted(map(tuple, S.quota_sample(FX.code_corpus(spark, SF_SMALL), 12, 16).collect()))
    monkeypatch.setattr(bounded, "MAX_INLINE_KEYS", 0)
    b = sorted(map(tuple, S.random_windows(corpus, 12, 16, seed=4).collect()))
    q2 = sorted(map(tuple, S.quota_sample(FX.code_corpus(spark, SF_SMALL), 12, 16).collect()))
    assert a == b and q1 == q2


def test_more_empty_and_degenerate_inputs(spark):
    from calibspark.operators import stream_windows as SW
    from calibspark.operators.multiple_testing import bh_adjust_two_level
    empty = spark.createDataFrame([], "pos long, text string, meta string")
    corpus = document_corpus(spark, SF_SMALL)
    assert S.random_windows(corpus, 0, 8).count() == 0
    assert S.qa_head(empty, 5, 8).count() == 0
    assert SW.stream_windows(empty.select("pos", "text"), 3, 8).count() == 0
    assert SW.encode_stream(empty.select("pos", "text"), 8).count() == 0
    assert SW.token_budget(empty.select("pos", "text"), 8, ndocs=10, n_chunks=2).count() == 0
    none = spark.createDataFrame([], "fam string, p_value double")
    assert bh_adjust_two_level(none, family=["fam"]).count() == 0
    # quota larger than the data: everything eligible and unique per repo is taken
    small = spark.createDataFrame([(0, "r1", "java"), (1, "r1", "python"), (2, "r2", "python")],
                                  "pos long, repo string, language string")
    assert sorted(r.pos for r in S.quota_select(small, 50, ["java", "python"]).collect()) == [0, 2]
