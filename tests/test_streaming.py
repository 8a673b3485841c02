"""Streaming restart: resume from checkpoint + state equals the batch result."""

import uuid

from pyspark.sql import functions as F

from calibspark.operators import sampling as S
from calibspark.session import scratch_path
from calibspark.sources import fixtures as FX
from calibspark.streaming import streams as ST
from tests.conftest import SF_MID


def test_stream_quota_resumes_after_restart(spark):
    code = FX.code_corpus(spark, SF_MID)
    src, state, ck = (scratch_path(spark, f"{n}-{uuid.uuid4().hex}") for n in ("src", "state", "ck"))
    first = code.where(F.col("pos") < 80)
    rest = code.where(F.col("pos") >= 80)
    ST.write_ordered_files(first, src, "pos", 2)
    part = ST.stream_quota(spark, src, code.schema, 64, 20, ["java", "python"], state, ck, files_per_trigger=4).count()
    assert 0 < part < 40
    # same query again: nothing new, nothing duplicated
    again = ST.stream_quota(spark, src, code.schema, 64, 20, ["java", "python"], state, ck, files_per_trigger=4).count()
    assert again == part
    ST.write_ordered_files(rest, src, "pos", 3)
    got = ST.stream_quota(spark, src, code.schema, 64, 20, ["java", "python"], state, ck, files_per_trigger=4)
    want = S.quota_select(S.code_candidates(code, 64), 20, ["java", "python"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("pos", "repo", "language").collect()))


def _dirs(spark):
    return tuple(scratch_path(spark, f"{n}-{uuid.uuid4().hex}") for n in ("src", "state", "ck"))


def test_late_files_change_the_selection_to_that_of_all_files(spark, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT", 2)
    code = FX.code_corpus(spark, SF_MID)
    src, state, ck = _dirs(spark)
    want = {}
    for part in (code.where(F.col("pos") >= 500), code.where(F.col("pos") < 500)):
        ST.write_ordered_files(part, src, "pos", 3, files=1, shuffle_seed=1)
        got = ST.stream_quota(spark, src, code.schema, 64, 20, ["java", "python"], state, ck)
        seen = spark.read.schema(code.schema).parquet(src)
        want = S.quota_select(S.code_candidates(seen, 64), 20, ["java", "python"]).select("pos", "repo", "language")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_of_smallest_positions_is_enough(spark):
    """Random small tables of three strata: selecting from the merged state equals selecting from all rows."""
    import random
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(i, f"r{rng.randrange(12)}", rng.choice("abc")) for i in range(60)]
        df = spark.createDataFrame(rows, "pos long, repo string, language string")
        state = df.groupBy("repo", "language").agg(F.min("pos").alias("pos"))
        pick = lambda x: sorted(tuple(r) for r in S.quota_select(x, 2, ["a", "b", "c"]).select("pos", "repo", "language").collect())
        assert pick(df) == pick(state)


def test_stream_stops_once_nothing_can_change(spark):
    qa = FX.qa_corpus(spark, SF_MID)
    src, state, ck = _dirs(spark)
    ST.write_ordered_files(qa, src, "pos", 8, files=1)
    got = sorted(r.pos for r in ST.stream_head(spark, src, qa.schema, 5, 64, state, ck, lateness=0).collect())
    assert got == sorted(r.pos for r in S.qa_candidates(qa, 64).orderBy("pos").limit(5).collect())
    read = spark.read.parquet(f"{state}/added").select("batch").distinct().count()
    assert read < 4  # of eight files
    again = ST.stream_head(spark, src, qa.schema, 5, 64, state, ck, lateness=0)
    assert sorted(r.pos for r in again.collect()) == got
