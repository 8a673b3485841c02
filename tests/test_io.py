"""Sinks and sources S8-S17, and the X1 UDF factory."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from calibspark.functions import tokens as TK
from calibspark.operators import passk as PK
from calibspark.operators import sampling as S
from calibspark.operators.split import split_train_val
from calibspark.plans import reports as R
from calibspark.session import scratch_path
from calibspark.sources import files as IO
from calibspark.sources import fixtures as FX
from tests.conftest import SF_SMALL


def fresh(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def test_results_csv_roundtrip(spark):
    a = FX.attempts_with_pass(spark, SF_SMALL)
    path = fresh(spark, "csv")
    IO.write_results_csv(a, path)
    back = IO.read_results_csv(spark, path)
    assert back.count() == a.count()
    assert back.agg(F.sum("pass")).first()[0] == a.agg(F.sum("pass")).first()[0]


def test_calibration_sinks(spark):
    sample = S.quota_sample(FX.code_corpus(spark, SF_SMALL), 8, 16).withColumn(
        "tokens", TK.tokenize(F.col("raw_data")))
    for fmt in ("csv", "json", "parquet"):
        path = fresh(spark, fmt)
        IO.write_calibration(sample, path, fmt)
        if fmt == "csv":
            back = spark.read.option("header", True).option("escape", "\\").option("multiLine", True).csv(path)
            toks = [json.loads(r.tokens) for r in back.collect()]
            assert all(len(t) == 16 for t in toks)
        else:
            assert spark.read.format(fmt).load(path).count() == sample.count()


def test_split_and_decoded_sinks(spark):
    sample = split_train_val(S.quota_sample(FX.code_corpus(spark, SF_SMALL), 8, 16), 2)
    p1, p2 = fresh(spark, "split"), fresh(spark, "dec")
    IO.write_split(sample, p1)
    IO.write_decoded(sample, p2)
    assert sorted(f for f in os.listdir(_local(p1)) if not f.startswith(".")) == ["_SUCCESS", "split=train", "split=val"]
    assert spark.read.json(p2).where("split = 'val'").count() == 2


def test_report_and_pass_report_sinks(spark):
    a = FX.attempts_with_pass(spark, SF_SMALL)
    p1, p2 = fresh(spark, "rep"), fresh(spark, "pass")
    IO.write_report(R.paired_report(a, R.RQ1), p1)
    IO.write_pass_report(PK.pass_at_k_table(a, [1, 10]), p2)
    rep = spark.read.option("header", True).csv(p1).collect()
    assert [int(r.report_pos) for r in rep] == list(range(1, 17))
    names = {f for f in os.listdir(_local(p2)) if f.startswith("report=")}
    assert len(names) == a.select("model", "quantization", "language").distinct().count()
    assert "report=pass_result_temp_0_2_py_codellama_7b_2bit.csv" in names


def test_reuse_or_build(spark):
    path = fresh(spark, "reuse")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5 + len(calls))

    first = IO.reuse_or_build(spark, path, build, parameters={"seed": 1})
    assert first.count() == IO.reuse_or_build(spark, path, build, parameters={"seed": 1}).count() == 6
    assert IO.reuse_or_build(spark, path, build, parameters={"seed": 2}).count() == 7
    assert first.count() == 6 and len(calls) == 2 and IO.stored_parameters(spark, path) == {"seed": 2}


def test_result_files_are_taken_in_once(spark):
    """New files only, a batch whose attempts are incomplete is done again, rows by bytes and not by files in a task."""
    from calibspark.plans import ingest as IG
    root, store = fresh(spark, "tree"), fresh(spark, "store")
    att = FX.attempts(spark, SF_SMALL)
    IG.write_result_tree(att.where("quantization = '2bit'"), root)
    first = IG.compact_results(spark, root, store)
    n = first.count()
    assert n == att.where("quantization = '2bit'").count() and IG.compact_results(spark, root, store).count() == n
    IG.write_result_tree(att.where("quantization = '3bit'"), root)
    total = IG.compact_results(spark, root, store).count()
    assert total == att.where("quantization IN ('2bit', '3bit')").count()
    os.remove(_local(f"{store}/attempts/batch=1/_SUCCESS"))  # as if the second batch had been cut short
    assert IG.compact_results(spark, root, store).count() == total
    with IO.small_files(spark):
        assert IO.read_results(spark, root).rdd.getNumPartitions() <= 8 < IO.read_results(spark, root).count()


def test_encoder_udf(spark):
    def make():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    enc = TK.encoder_udf(make, add_bos=1)
    rows = spark.createDataFrame([("ab cde",), ("",)], "t string").select(enc(F.col("t")).alias("ids")).collect()
    assert [list(r.ids) for r in rows] == [[1, 2, 3], [1]]


def test_recipes_with_model_tokenizer(spark):
    """X1 through the recipes: ids from a toy batch encoder with BOS."""
    from calibspark.operators import sampling as S
    from calibspark.sources.corpus import document_corpus

    def make_enc():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    def make_dec():
        return lambda rows: [" ".join("x" * i for i in r) for r in rows]

    tok = TK.udf_tokenizer(make_enc, make_dec, add_bos=1)
    w = S.random_windows(document_corpus(spark, SF_SMALL), 6, 12, seed=3, tok=tok).collect()
    assert len(w) == 6 and all(r.num_tokens == 12 for r in w)
    q = S.quota_sample(FX.code_corpus(spark, SF_SMALL), 8, 12, tok=tok).collect()
    assert len(q) == 8 and all(r.num_tokens == 12 and r.raw_data.startswith("x ") for r in q)


def test_read_corpus_json_shards_subset_split(spark):
    from calibspark.sources.corpus import read_corpus
    path = fresh(spark, "corpus-json")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    (docs.select(F.col("doc_id").alias("pos"), "text", F.col("source").alias("meta"),
                 F.when(F.col("doc_id") % 2 == 0, "github").otherwise("stackexchange").alias("subset"),
                 F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"))
     .repartition(4).write.option("compression", "gzip").json(path))
    schema = "pos long, text string, meta string, subset string, split string"
    c = read_corpus(spark, path, fmt="json", subset="github", split="train", schema=schema)
    got = sorted(r.pos for r in c.collect())
    want = sorted(r.doc_id for r in docs.where("doc_id % 2 = 0 AND doc_id % 5 <> 0").collect())
    assert got == want
    assert c.columns == ["pos", "text", "meta"]
    with pytest.raises(ValueError):  # no inference pass over a corpus
        read_corpus(spark, path, fmt="json")
    # without an order column: unique ordinals that follow the files
    files = read_corpus(spark, path, fmt="json", schema=schema, pos_col=None).collect()
    assert len({r.pos for r in files}) == len(files) == docs.count()
    first = spark.read.schema(schema).json(path).select("text", F.col("_metadata.file_path").alias("f")).collect()
    of = {}
    for r in first:
        of.setdefault(r.text, set()).add(r.f)
    seen = [next(iter(of[r.text])) for r in sorted(files, key=lambda r: r.pos) if len(of[r.text]) == 1]
    assert len(set(seen)) == 4 and seen == sorted(seen)


def test_completions_keep_unknown_fields_and_compaction(spark):
    import json
    from calibspark.plans import cleaning as CL
    from calibspark.plans import ingest as IG
    root = fresh(spark, "cc")
    CL.write_completion_tree(FX.code_completions(spark, SF_SMALL), root)
    objects = CL.clean_completion_files(spark, root, "py")
    assert objects.count() == 40 and objects.where("size(completions) = 0").count() == 8
    got = [json.loads(r.object) for r in objects.collect()]
    assert all(x["extra"] == {"a": 1, "b": [True]} and x["temperature"] == 0.2 and len(x) == 9 for x in got)
    rroot, out = fresh(spark, "rr"), fresh(spark, "compact")
    IG.write_result_tree(FX.attempts(spark, SF_SMALL).where("model = 'codellama-7b'"), rroot)
    a = IG.compact_results(spark, rroot, out).count()
    assert a == IG.compact_results(spark, rroot, out).count() == 40 * 2 * 20 * 20


def test_clean_job_end_to_end(spark):
    from calibspark.plans import cleaning as CL
    root, out = fresh(spark, "cj-in"), fresh(spark, "cj-out")
    CL.write_completion_tree(FX.code_completions(spark, SF_SMALL), root)
    CL.clean_job(spark, root, out, language="py")
    back = spark.read.json(out)
    assert back.count() == 40
    assert sorted(r.run for r in back.select("run").distinct().collect()) == ["runA/py_benchmark", "runB/py_benchmark"]
    row = back.where("name = 'P_3'").first()
    assert len(row.completions) == 3 and row.prompt.startswith("x = 3")
