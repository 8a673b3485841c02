"""Recipe registry and the three-corpus batch job."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.functions.tokens import WORDS, Tokenizer
from calibspark.operators import sampling as S
from calibspark.operators import stream_windows as SW
from calibspark.operators.split import pretokenized_head, split_token_totals, split_train_val
from calibspark.sources.files import input_identity, path_exists, reuse_or_build

# fixed values: recipe names; train-only ones reject eval mode
TRAIN_ONLY = {"pajama", "github_code", "code_technical_language"}
STREAM_SEPARATORS = {"wikitext2": "\n\n", "ptb": "\n\n", "ptb_new": " "}
JOB_RECIPES = ["pajama", "github_code", "code_technical_language"]


def load_calibration(spark: SparkSession, name: str, corpus: DataFrame | None = None,
                     qa: DataFrame | None = None, nsamples: int = 128, seed: int = 0,
                     seqlen: int = 2048, eval_mode: bool = False,
                     tok: Tokenizer = WORDS) -> DataFrame | None:
    """Dispatch a recipe by name (case-insensitive).

    ``corpus``: (pos, text, meta) -- the code corpus for the code recipes;
    ``qa``: the Q&A corpus of the mixed recipe.  ``'none'`` gives None; an
    existing path is a pre-tokenized table (first ``nsamples``).  ``tok``
    applies to the document recipes; the stream recipes use the word
    tokenizer, whose tokens of a concatenation are the concatenated tokens,
    and refuse any other.
    """
    key = name.lower()
    if key == "none":
        return None
    if key not in TRAIN_ONLY | set(STREAM_SEPARATORS) | {"c4", "c4_new"} and path_exists(spark, name):
        return pretokenized_head(spark.read.parquet(name), nsamples)
    if key in TRAIN_ONLY and eval_mode:
        raise ValueError(f"{name}: only the train split is supported")
    if key == "pajama":
        return S.random_windows(corpus, nsamples, seqlen, seed, strict=True, tok=tok)
    if key == "github_code":
        return S.quota_sample(corpus, nsamples, seqlen, tok=tok)
    if key == "code_technical_language":
        return S.mixed_sample(qa, corpus, nsamples, seqlen, tok=tok)
    streams = key in STREAM_SEPARATORS or (key == "c4_new" and eval_mode)
    if streams and tok is not WORDS:
        raise ValueError(f"{name}: a stream recipe keeps the word tokenizer; its per-document form is exact for that one only")
    if key in STREAM_SEPARATORS:
        sep = STREAM_SEPARATORS[key]
        if eval_mode:
            return SW.encode_stream(corpus, seqlen, sep)
        return SW.stream_windows(corpus, nsamples, seqlen, sep, seed)
    if key == "c4":
        if eval_mode:
            return S.validation_windows(corpus, seqlen, n=256, seed=0, tok=tok)
        return S.random_windows(corpus, nsamples, seqlen, seed, strict=False, tok=tok)
    if key == "c4_new":
        if eval_mode:
            return SW.token_budget(corpus, seqlen, ndocs=1100, n_chunks=256, sep=" ")
        return S.random_windows(corpus, nsamples, seqlen, seed, strict=False, tok=tok)
    raise ValueError(f"Failed to load data from {name}: unknown recipe or path")


def build_all(spark: SparkSession, code: DataFrame, qa: DataFrame, random_corpus: DataFrame,
              out_dir: str, nsamples: int = 1024, val_size: int = 128, seqlen: int = 4096,
              seed: int = 0, tok: Tokenizer = WORDS, tokenizer_name: str | None = None) -> DataFrame:
    """The three calibration corpora, each split into train/validation,
    written (binary + decoded) and reused when there for the same parameters
    and inputs (a tokenizer of one's own needs a ``tokenizer_name`` for that).
    Returns the sequence and token totals per (recipe, split)."""
    totals = []
    for name in JOB_RECIPES:
        corpus = random_corpus if name == "pajama" else code
        inputs = [corpus, qa] if name == "code_technical_language" else [corpus]
        # an output is used again only for the same parameters, tokenizer and input files
        parameters = {"recipe": name, "nsamples": nsamples, "val_size": val_size, "seqlen": seqlen, "seed": seed,
                      "tokenizer": tokenizer_name or ("words" if tok is WORDS else uuid.uuid4().hex), "inputs": input_identity(*inputs)}

        def build(name=name, corpus=corpus):
            sample = load_calibration(spark, name, corpus, qa, nsamples, seed, seqlen, tok=tok)
            return split_train_val(sample, val_size, seed)

        path = f"{out_dir.rstrip('/')}/{name}"
        split = reuse_or_build(spark, f"{path}/split", build, parameters=parameters)
        decoded = lambda split=split: split.select("split", "sample_id", "raw_data")
        reuse_or_build(spark, f"{path}/decoded", decoded, "json", parameters)
        totals.append(split_token_totals(split).withColumn("recipe", F.lit(name)))
    return reduce(DataFrame.unionByName, totals)
