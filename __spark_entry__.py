"""

``queries()[name](spark, sf_dir)`` returns the Spark result; the DuckDB
twin ``oracle_sql()[name]`` runs on the same parquet tables.  Doubles are
rounded to 9 places on both sides; every computed column is aliased to the
same name in both.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.functions import meta as MT
from calibspark.functions import text as TX
from calibspark.functions import tokens as TK
from calibspark.operators import completions as CM
from calibspark.operators import ordinals as OR
from calibspark.operators import validation as VL
from calibspark.operators import padding as PD
from calibspark.operators import passk as PK
from calibspark.operators import sampling as S
from calibspark.operators import split as SP
from calibspark.operators import stream_windows as SW
from calibspark.sources import corpus as CP
from calibspark.operators.ordering import with_sort_position
from calibspark.operators.paired import Comparison
from calibspark.plans import cleaning as CL
from calibspark.plans import ingest as IG
from calibspark.plans import recipes as RC
from calibspark.plans import reports as R
from calibspark.session import scratch_path
from calibspark.sources import files as IO
from calibspark.streaming import streams as ST_
from calibspark.plans import statistics as ST
from calibspark.sources import fixtures as FX
from calibspark.sources.tables import table

LLM = PIPE = None
if find_spec("calibspark.llm") and find_spec("corpus_pipeline"):  # the training-data operators are an optional part
    import corpus_pipeline as PIPE
    from calibspark.llm import registry as LLM

DIGITS = 9
SF_SMOKE = "/root/testdata/sf0.001"


def _round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(F.round(F.col(f.name), DIGITS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _report(spec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_doubles(R.paired_report(FX.attempts_with_pass(spark, sf_dir), spec))
    return run


def _att(spark, sf_dir):
    return FX.attempts_with_pass(spark, sf_dir)


def q_contingency(spark, sf_dir):
    cmps = [Comparison("16bit", q, first="other") for q, _ in FX.FIXTURE_THRESHOLDS if q != "16bit"]
    return ST.contingency_table(_att(spark, sf_dir), cmps)


def q_pass_at(k):
    def run(spark, sf_dir):
        return _round_doubles(PK.pass_at_k_table(_att(spark, sf_dir), [k]))
    return run


def q_pass_rate(spark, sf_dir):
    return _round_doubles(PK.pass_rate(_att(spark, sf_dir)))


def q_bh_adjust(spark, sf_dir):
    return _round_doubles(ST.per_problem_tests(_att(spark, sf_dir), "16bit", "2bit"))


def q_outcome_flag(spark, sf_dir):
    return _att(spark, sf_dir)


def q_path_dimensions(spark, sf_dir):
    return ST.parse_result_paths(ST.result_paths(FX.attempts(spark, sf_dir)))


def q_run_labels(spark, sf_dir):
    return ST.run_labels(FX.attempts(spark, sf_dir))


def q_custom_sort(spark, sf_dir):
    from oracle import CUSTOM_SORT_SPEC
    return _round_doubles(with_sort_position(PK.pass_rate(_att(spark, sf_dir)), CUSTOM_SORT_SPEC, "model"))


def q_label_families(spark, sf_dir):
    return ST.label_families(_att(spark, sf_dir), ["3bit", "2bit"])


def q_experiment_grid(spark, sf_dir):
    return ST.experiment_grid(FX.attempts(spark, sf_dir), R.RQ2.comparisons)


def q_completion_cap(spark, sf_dir):
    return PK.cap_attempts(_att(spark, sf_dir), 10)


def q_paired_labels(spark, sf_dir):
    rep = R.column_pair_report(FX.labelled_documents(spark, sf_dir), "quality", "toxic", ["lang"], family=[])
    return _round_doubles(rep)


# ---------------------------------------------------------------- corpus side
SEQLEN = 64


def _docs_corpus(spark, sf_dir):
    return CP.document_corpus(spark, sf_dir)


def q_meta_parse(spark, sf_dir):
    m = MT.parse_meta(F.col("meta"))
    return FX.code_corpus(spark, sf_dir).select(
        "pos", m.isNotNull().alias("meta_valid"), m["source"].alias("source"),
        m["repo_name"].alias("repo_name"), m["path"].alias("path"),
        MT.has_key(m, "path").alias("has_path"))


def q_meta_filters(spark, sf_dir):
    return S.code_candidates(FX.code_corpus(spark, sf_dir), -1).select("pos", "repo", "language")


def q_qa_filters(spark, sf_dir):
    return S.qa_candidates(FX.qa_corpus(spark, sf_dir), -1)


def q_token_counts(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", TK.token_count(F.col("text")).alias("n_tokens"),
                    (TK.decode(TK.tokenize(F.col("text"))) == F.regexp_replace("text", r"\s+$", ""))
                    .alias("lossless"))


def q_length_gate(strict):
    def run(spark, sf_dir):
        d = FX.table(spark, sf_dir, "documents", "doc_id", "text")
        return S.length_gate(S.with_token_count(d).select("doc_id", "n_tokens"), 512, strict)
    return run


def q_head_tokens(spark, sf_dir):
    d = S.length_gate(S.with_token_count(FX.table(spark, sf_dir, "documents", "doc_id", "text")), SEQLEN)
    head = TK.head_tokens(TK.tokenize(F.col("text")), SEQLEN)
    return d.select("doc_id", TK.decode(head).alias("raw_data"), F.size(head).alias("num_tokens"))


def q_random_windows(spark, sf_dir):
    return S.random_windows(_docs_corpus(spark, sf_dir), 40, SEQLEN, seed=0, strict=True)


def q_random_windows_c4(spark, sf_dir):
    return S.random_windows(_docs_corpus(spark, sf_dir), 40, SEQLEN, seed=1, strict=False)


def q_random_windows_sparse(spark, sf_dir):
    """C1 over positions with gaps, many index blocks of which few are read."""
    pos = F.col("pos") * 5003 + F.col("pos") % 7
    return S.random_windows(_docs_corpus(spark, sf_dir).withColumn("pos", pos), 40, SEQLEN, seed=2, strict=True)


def q_ordinals_sparse(spark, sf_dir):
    """W2 over positions that are neither dense nor stored in order."""
    return OR.pos_ordinals(table(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") * 37 % 1000003).alias("pos")))


def q_validation_windows(spark, sf_dir):
    return S.validation_windows(_docs_corpus(spark, sf_dir), SEQLEN, n=256, seed=0)


def q_quota_sample(spark, sf_dir):
    return S.quota_sample(FX.code_corpus(spark, sf_dir), 40, SEQLEN)


def q_qa_head(spark, sf_dir):
    return S.qa_head(FX.qa_corpus(spark, sf_dir), 20, SEQLEN)


def q_mixed_sample(spark, sf_dir):
    return S.mixed_sample(FX.qa_corpus(spark, sf_dir), FX.code_corpus(spark, sf_dir), 40, SEQLEN)


def q_stratum_counts(spark, sf_dir):
    return S.stratum_counts(S.quota_sample(FX.code_corpus(spark, sf_dir), 40, SEQLEN))


def q_shortage(spark, sf_dir):
    sample = S.quota_sample(FX.code_corpus(spark, sf_dir), 80, SEQLEN, quota=40)
    return S.shortage(sample, 40, ["java", "python"])


def _split(spark, sf_dir):
    return SP.split_train_val(S.quota_sample(FX.code_corpus(spark, sf_dir), 40, SEQLEN), 8, seed=0)


def q_train_val_split(spark, sf_dir):
    return _split(spark, sf_dir)


def q_split_token_totals(spark, sf_dir):
    return SP.split_token_totals(_split(spark, sf_dir))


def q_pretokenized_head(spark, sf_dir):
    return SP.pretokenized_head(FX.token_rows(spark, sf_dir), 100, "doc_id").select(
        "doc_id", F.size("ids").alias("n_ids"))


def _plain_corpus(spark, sf_dir):
    return FX.table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("pos"), "text")


def q_stream_offsets(spark, sf_dir):
    return SW.stream_offsets(_plain_corpus(spark, sf_dir))


def q_stream_windows(spark, sf_dir):
    return SW.stream_windows(_plain_corpus(spark, sf_dir), 40, SEQLEN, sep="\n\n", seed=0)


def q_stream_chunks(spark, sf_dir):
    return SW.encode_stream(_plain_corpus(spark, sf_dir), SEQLEN, sep="\n\n")


def q_token_budget(spark, sf_dir):
    return SW.token_budget(_plain_corpus(spark, sf_dir), SEQLEN, ndocs=1100, n_chunks=256, sep=" ")


# ---------------------------------------------------------------- completions
STOPS = [".\n", ", "]


def _reply(spark, sf_dir):
    return FX.reply_completions(spark, sf_dir)


def q_strip_prompt(spark, sf_dir):
    return _reply(spark, sf_dir).select("conv_id", "turn", TX.strip_text(F.col("prompt")).alias("prompt_stripped"))


def q_prompt_removal(spark, sf_dir):
    r = _reply(spark, sf_dir).withColumn("p", TX.strip_text(F.col("prompt")))
    return r.select("conv_id", "turn", TX.drop_prefix_chars(F.concat("p", "completion"), F.col("p")).alias("generated"))


def q_stop_truncate(spark, sf_dir):
    return _reply(spark, sf_dir).select("conv_id", "turn", TX.stop_at(F.col("completion"), STOPS).alias("truncated"))


def q_left_pad(spark, sf_dir):
    tr = PD.with_batch_width(FX.token_rows(spark, sf_dir), "doc_id", "ids", 8)
    return tr.select("doc_id", "width", F.array_join(TK.left_pad(F.col("ids"), 0, F.col("width")), ",").alias("padded"))


def q_trim_special_ids(spark, sf_dir):
    tr = FX.token_rows(spark, sf_dir)
    kept = TK.trim_generated(F.col("ids"), pad_id=0, bos_id=1, specials=[0, 1, 2])
    return tr.select("doc_id", F.size(TK.truncate_ids(F.col("ids"), 1024)).alias("n_truncated"),
                     F.array_join(kept, ",").alias("kept"))


def _cut(spark, sf_dir, language="py"):
    cc = FX.code_completions(spark, sf_dir, language)
    return cc.select("item_id", "attempt", "language", CM.cut_first_function(
        F.col("prompt"), F.col("completion"), CM.language_name(F.col("language"))).alias("cleaned"))


def q_cut_first_function(spark, sf_dir):
    return _cut(spark, sf_dir).drop("language")


def q_cut_first_function_strict(spark, sf_dir):
    """Both languages, told apart by their column."""
    return _cut(spark, sf_dir).unionByName(_cut(spark, sf_dir, "java"))


def q_strip_comments(spark, sf_dir):
    cc = FX.code_completions(spark, sf_dir)
    code = TX.prompt_code(F.col("prompt"), F.col("completion"))
    return cc.select("item_id", "attempt", CM.strip_comments(code, F.lit("python")).alias("stripped"))


def q_split_doc(spark, sf_dir):
    cc = FX.code_completions(spark, sf_dir)
    code = TX.prompt_code(F.col("prompt"), F.col("completion"))
    parts = CM.split_doc(F.when(F.col("attempt") == 0, F.concat(F.lit("# "), code)).otherwise(code), F.lit("python"))
    return cc.select("item_id", "attempt", parts["doc"].alias("doc"), parts["func"].alias("func"))


def q_regroup_completions(spark, sf_dir):
    g = CM.regroup_completions(_cut(spark, sf_dir).withColumnRenamed("cleaned", "completion"), ["item_id"])
    return g.select("item_id", F.size("completions").cast("long").alias("n_completions"),
                    F.array_join("completions", "\u001e").alias("completions_joined"))


def q_validate_names(spark, sf_dir):
    return VL.validate_names(FX.attempts(spark, sf_dir))


def q_tokenizer_checks(spark, sf_dir):
    return VL.tokenizer_checks(VL.tokenizer_configs(FX.attempts(spark, sf_dir)))


# ---------------------------------------------------------------- file jobs
def _fresh(spark, name):
    import uuid
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_ingest_results(spark, sf_dir):
    root = _fresh(spark, "results")
    IG.write_result_tree(FX.attempts(spark, sf_dir), root)
    return IG.ingest_results(spark, root)


def q_clean_completions(language):
    """X7 through files: the cleaned objects are written (S13) and read back whole."""
    def run(spark, sf_dir):
        root, out = _fresh(spark, "completions"), _fresh(spark, "cleaned")
        CL.write_completion_tree(FX.code_completions(spark, sf_dir, language), root)
        CL.clean_job(spark, root, out, language)
        schema = ("name string, completions array<string>, language string, temperature double, top_p double, tests string, "
                  "extra struct<b: array<boolean>>")
        back = spark.read.schema(schema + ", run string").json(out)
        return back.select(F.concat("run", F.lit("/"), "name", F.lit(".json.gz")).alias("rel_path"), "name",
                           F.size("completions").cast("long").alias("n_completions"),
                           F.array_join("completions", "\u001e").alias("completions_joined"),
                           "language", "temperature", "top_p", "tests", F.col("extra.b")[0].alias("extra_b"))
    return run


def q_report_from_csv(spark, sf_dir):
    """The report computed from the results CSV."""
    path = _fresh(spark, "results-report")
    IO.write_results_csv(_att(spark, sf_dir), path)
    return _round_doubles(R.paired_report(IO.read_results_csv(spark, path), R.RQ1))


def q_corpus_scan(spark, sf_dir):
    """S10 then S1-S4: documents as JSON lines by language, one subset read back with a schema."""
    path = _fresh(spark, "corpus")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    IO.write_calibration(docs.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train")), path, fmt="json")
    return CP.read_corpus(spark, path, pos_col="doc_id", meta_col="source", fmt="json", subset="en", subset_col="lang",
                          split="train", schema="doc_id long, text string, lang string, source string, split string")


def q_corpus_arrival(spark, sf_dir):
    """Gzipped JSON-lines shards without an order column; ordinals over
    the whole corpus, then one subset of one split."""
    path = _fresh(spark, "shards")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    docs = docs.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train"))
    (docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
     .write.option("compression", "gzip").json(path))
    return CP.read_corpus(spark, path, pos_col=None, meta_col="doc_id", fmt="json", subset="en", subset_col="lang",
                          split="train", schema="doc_id string, text string, lang string, source string, split string")


def q_corpus_arrival_parquet(spark, sf_dir):
    """Ordinals of Parquet files without an order column."""
    path = _fresh(spark, "parts")
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    docs.repartitionByRange(9, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return CP.read_corpus(spark, path, pos_col=None, meta_col="doc_id")


def q_keep_until(spark, sf_dir):
    """lines up to the second, which is cut at its fifth character."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", TX.keep_until(F.col("text"), F.lit(1), F.lit(5)).alias("kept"))


def q_results_csv(spark, sf_dir):
    """S14 then S8: results table through CSV."""
    path = _fresh(spark, "results-csv")
    IO.write_results_csv(_att(spark, sf_dir), path)
    return IO.read_results_csv(spark, path)


def q_calibration_csv(spark, sf_dir):
    """Calibration rows through CSV with backslash escapes (multi-line text)."""
    path = _fresh(spark, "calib-csv")
    IO.write_calibration(S.quota_sample(FX.code_corpus(spark, sf_dir), 40, SEQLEN), path, "csv")
    schema = ("sample_id long, doc_pos long, start int, num_tokens int, raw_data string, meta string, "
              "language string, repo string")
    return (spark.read.schema(schema).option("header", True).option("escape", "\\")
            .option("multiLine", True).csv(path))


def q_pass_report(spark, sf_dir):
    """pass@k reports under their names, read back."""
    path = _fresh(spark, "pass-report")
    IO.write_pass_report(_round_doubles(PK.pass_at_k_table(_att(spark, sf_dir), [1, 10])), path)
    return IO.read_pass_report(spark, path, "model string, quantization string, language string, num_problems long, "
                               "min_completions int, max_completions int, k int, pass_at_k double")


def q_batch_job(spark, sf_dir):
    """The three recipes; then with another seed, whose outputs
    must be built anew, and once more, whose outputs are used again."""
    out = _fresh(spark, "batch")
    args = (spark, FX.code_corpus(spark, sf_dir), FX.qa_corpus(spark, sf_dir), _docs_corpus(spark, sf_dir), out)
    for seed in (0, 1, 1):
        totals = RC.build_all(*args, nsamples=40, val_size=8, seqlen=SEQLEN, seed=seed)
    chosen = IO.reuse_or_build(spark, f"{out}/pajama/split", lambda: spark.sql("SELECT raise_error('built again')"),
                               parameters=IO.stored_parameters(spark, f"{out}/pajama/split"))
    return chosen.join(totals.where("recipe = 'pajama'"), "split")


def q_split_files(spark, sf_dir):
    """Split sample and decoded text, read back from their folders."""
    path = _fresh(spark, "split")
    IO.write_split(_split(spark, sf_dir), f"{path}/bin")
    IO.write_decoded(spark.read.parquet(f"{path}/bin"), f"{path}/decoded")
    return spark.read.schema("sample_id long, raw_data string, split string").json(f"{path}/decoded")


def q_report_csv(spark, sf_dir):
    """The RQ1 report as one ordered CSV, read back."""
    path = _fresh(spark, "report")
    IO.write_report(_report(R.RQ1)(spark, sf_dir), path)
    schema = ("row_id int, base_precision string, quant_precision string, lng string, model string, "
              "n_pairs long, b long, c long, p_value double, p_adj double, odds_ratio double, "
              "or_infinite boolean, report_pos int")
    return spark.read.schema(schema).option("header", True).csv(path)


# ---------------------------------------------------------------- streaming
def _stream_src(spark, df, name, n_files=3, shuffle_seed=None):
    src = _fresh(spark, name)
    ST_.write_ordered_files(df, src, "pos", n_files, shuffle_seed=shuffle_seed)
    return src


def q_stream_filter(spark, sf_dir):
    code = FX.code_corpus(spark, sf_dir)
    src = _stream_src(spark, code, "code-src")
    out = ST_.stream_code_candidates(spark, src, code.schema, SEQLEN, _fresh(spark, "t1-out"), _fresh(spark, "t1-ck"))
    return out.select("pos", "repo", "language", "n_tokens")


def _stream_quota(shuffle_seed, lateness):
    def run(spark, sf_dir):
        code = FX.code_corpus(spark, sf_dir)
        src = _stream_src(spark, code, "code-src", 5, shuffle_seed)
        return ST_.stream_quota(spark, src, code.schema, SEQLEN, 20, ["java", "python"], _fresh(spark, "t2-state"),
                                _fresh(spark, "t2-ck"), files_per_trigger=4, lateness=lateness)
    return run


def _stream_head(shuffle_seed, lateness):
    def run(spark, sf_dir):
        qa = FX.qa_corpus(spark, sf_dir)
        src = _stream_src(spark, qa, "qa-src", 5, shuffle_seed)
        return ST_.stream_head(spark, src, qa.schema, 20, SEQLEN, _fresh(spark, "t3-state"), _fresh(spark, "t3-ck"),
                               files_per_trigger=4, lateness=lateness)
    return run


def q_stream_pass_rate(spark, sf_dir):
    root = _fresh(spark, "results")
    IG.write_result_tree(FX.attempts(spark, sf_dir), root)
    out = ST_.stream_pass_rate(spark, root, _fresh(spark, "t4-store"), _fresh(spark, "t4-out"), _fresh(spark, "t4-ck"))
    return _round_doubles(out)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the RQ1 paired report (16-bit vs 8/4/3/2-bit) at sf0.001."""
    return queries()["report_rq1"](spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "report_rq1": _report(R.RQ1),
        "report_rq1_finetuned": _report(R.RQ1_FINETUNED),
        "report_rq2": _report(R.RQ2),
        "report_rq3": _report(R.RQ3),
        "contingency": q_contingency,
        "pass_at_1": q_pass_at(1),
        "pass_at_10": q_pass_at(10),
        "pass_rate": q_pass_rate,
        "bh_adjust": q_bh_adjust,
        "outcome_flag": q_outcome_flag,
        "path_dimensions": q_path_dimensions,
        "run_labels": q_run_labels,
        "custom_sort": q_custom_sort,
        "label_families": q_label_families,
        "experiment_grid": q_experiment_grid,
        "completion_cap": q_completion_cap,
        "paired_labels": q_paired_labels,
        "meta_parse": q_meta_parse,
        "meta_filters": q_meta_filters,
        "qa_filters": q_qa_filters,
        "token_counts": q_token_counts,
        "length_gate": q_length_gate(True),
        "length_gate_inclusive": q_length_gate(False),
        "head_tokens": q_head_tokens,
        "random_windows": q_random_windows,
        "random_windows_c4": q_random_windows_c4,
        "random_windows_sparse": q_random_windows_sparse,
        "ordinals_sparse": q_ordinals_sparse,
        "validation_windows": q_validation_windows,
        "quota_sample": q_quota_sample,
        "qa_head": q_qa_head,
        "mixed_sample": q_mixed_sample,
        "stratum_counts": q_stratum_counts,
        "shortage": q_shortage,
        "train_val_split": q_train_val_split,
        "split_token_totals": q_split_token_totals,
        "pretokenized_head": q_pretokenized_head,
        "stream_offsets": q_stream_offsets,
        "stream_windows": q_stream_windows,
        "stream_chunks": q_stream_chunks,
        "token_budget": q_token_budget,
        "strip_prompt": q_strip_prompt,
        "prompt_removal": q_prompt_removal,
        "stop_truncate": q_stop_truncate,
        "left_pad": q_left_pad,
        "trim_special_ids": q_trim_special_ids,
        "cut_first_function": q_cut_first_function,
        "cut_first_function_strict": q_cut_first_function_strict,
        "strip_comments": q_strip_comments,
        "split_doc": q_split_doc,
        "regroup_completions": q_regroup_completions,
        "validate_names": q_validate_names,
        "tokenizer_checks": q_tokenizer_checks,
        "ingest_results": q_ingest_results,
        "clean_completions_job": q_clean_completions("py"),
        "clean_completions_java": q_clean_completions("java"),
        "report_from_csv": q_report_from_csv,
        "corpus_scan": q_corpus_scan,
        "corpus_arrival": q_corpus_arrival,
        "corpus_arrival_parquet": q_corpus_arrival_parquet,
        "keep_until": q_keep_until,
        "results_csv": q_results_csv,
        "calibration_csv": q_calibration_csv,
        "pass_report": q_pass_report,
        "batch_job": q_batch_job,
        "split_files": q_split_files,
        "report_csv": q_report_csv,
        "stream_filter": q_stream_filter,
        # late files, then files in order with an early stop
        "stream_quota": _stream_quota(3, None),
        "stream_quota_stop": _stream_quota(None, 0),
        "stream_head": _stream_head(3, None),
        "stream_head_stop": _stream_head(None, 0),
        "stream_pass_rate": q_stream_pass_rate,
        **(LLM.queries() | {"pipeline": PIPE.run} if LLM else {}),
    }


def oracle_sql() -> dict[str, str]:
    from oracle import oracle_queries
    piped = {"pipeline": PIPE.ORACLE_SQL} if LLM and PIPE.ORACLE_SQL else {}
    return oracle_queries() | (LLM.oracle_sql() | piped if LLM else {})
