"""Recipe registry and batch job."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from calibspark.plans.recipes import build_all, load_calibration
from calibspark.session import scratch_path
from calibspark.sources import files as IO
from calibspark.sources import fixtures as FX
from calibspark.sources.corpus import document_corpus
from tests.conftest import SF_SMALL


def test_dispatch(spark):
    code, qa = FX.code_corpus(spark, SF_SMALL), FX.qa_corpus(spark, SF_SMALL)
    docs = document_corpus(spark, SF_SMALL)
    assert load_calibration(spark, "none") is None
    assert load_calibration(spark, "PAJAMA", docs, nsamples=6, seqlen=16).count() == 6
    assert load_calibration(spark, "github_code", code, nsamples=8, seqlen=16).count() == 8
    mixed = load_calibration(spark, "code_technical_language", code, qa, nsamples=8, seqlen=16)
    assert sorted(r.part for r in mixed.collect()).count("qa") == 4
    assert load_calibration(spark, "wikitext2", docs, nsamples=5, seqlen=16).count() == 5
    import pytest
    from calibspark.functions.tokens import Tokenizer
    with pytest.raises(ValueError):  # another tokenizer is refused, not ignored
        load_calibration(spark, "wikitext2", docs, nsamples=5, seqlen=16, tok=object.__new__(Tokenizer))
    chunks = load_calibration(spark, "ptb_new", docs, seqlen=64, eval_mode=True)
    assert chunks.agg(F.max("num_tokens")).first()[0] == 64
    assert load_calibration(spark, "c4", docs, seqlen=16, eval_mode=True).count() == 256
    with pytest.raises(ValueError):
        load_calibration(spark, "pajama", docs, eval_mode=True)
    with pytest.raises(ValueError):
        load_calibration(spark, "no-such-recipe", docs)


def test_pretokenized_path(spark):
    path = scratch_path(spark, f"pretok-{uuid.uuid4().hex}")
    spark.range(50).withColumnRenamed("id", "sample_id").write.parquet(path)
    assert [r.sample_id for r in load_calibration(spark, path, nsamples=7).collect()] == list(range(7))


def test_build_all_reuses_outputs(spark):
    code, qa = FX.code_corpus(spark, SF_SMALL), FX.qa_corpus(spark, SF_SMALL)
    docs = document_corpus(spark, SF_SMALL)
    out = scratch_path(spark, f"build-{uuid.uuid4().hex}")
    t1 = {(r.recipe, r.split): (r.n_sequences, r.total_tokens)
          for r in build_all(spark, code, qa, docs, out, nsamples=8, val_size=2, seqlen=16).collect()}
    assert t1[("pajama", "val")] == (2, 32) and t1[("github_code", "train")] == (6, 96)
    t2 = {(r.recipe, r.split): (r.n_sequences, r.total_tokens)
          for r in build_all(spark, code, qa, docs, out, nsamples=8, val_size=2, seqlen=16).collect()}
    assert t1 == t2


def test_build_all_builds_anew_for_other_parameters(spark):
    """Another seed or another corpus isn't served from an older output; the older one stays whole for its readers."""
    docs = document_corpus(spark, SF_SMALL)
    code, qa = FX.code_corpus(spark, SF_SMALL), FX.qa_corpus(spark, SF_SMALL)
    out = scratch_path(spark, f"build-{uuid.uuid4().hex}")
    rows = []
    for seed, corpus in ((0, docs), (5, docs), (5, docs.where("pos < 100")), (5, docs.where("pos < 100"))):
        build_all(spark, code, qa, corpus, out, nsamples=8, val_size=2, seqlen=16, seed=seed).collect()
        made = spark.read.parquet(IO.reuse_or_build(spark, f"{out}/pajama/split", None, parameters=IO.stored_parameters(
            spark, f"{out}/pajama/split")).inputFiles()[0].rsplit("/", 1)[0])
        rows.append(sorted(map(tuple, made.collect())))
    assert rows[0] != rows[1] and rows[1] != rows[2] and rows[2] == rows[3]
    assert len([f for f in os.listdir(f"{out}/pajama/split") if f.startswith("build-")]) == 3
