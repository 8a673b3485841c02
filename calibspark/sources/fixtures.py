"""Derived input views (FIXTURES.md section 3), built from the given tables.

The reference reads corpora, completion files and result files that are not
part of the given data; these views re-create their shapes from
``benchmark``, ``documents``, ``labels`` and ``conversations`` by
deterministic expressions, so every query's work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.functions.hashing import h48
from calibspark.functions.outcomes import pass_flag
from calibspark.sources.tables import table

# ---- fixed values of the attempts fixture (FIXTURES.md view A) -------------
FIXTURE_MODELS = ["deepseekcoder-1b", "codellama-7b", "deepseekcoder-7b",
                  "codellama-13b", "deepseekcoder-33b", "codellama-34b"]
FIXTURE_LANGUAGES = ["py", "java"]
FIXTURE_THRESHOLDS = [
    ("16bit", 420), ("8bit", 418), ("4bit", 400), ("3bit", 340), ("2bit", 220),
    ("3bit-finetuned", 360), ("2bit-finetuned", 300),
    ("8bit-rnd", 418), ("8bit-mixed", 419), ("8bit-code", 420),
    ("4bit-rnd", 400), ("4bit-mixed", 405), ("4bit-code", 403),
    ("3bit-rnd", 340), ("3bit-mixed", 370), ("3bit-code", 372),
    ("2bit-rnd", 220), ("2bit-mixed", 290), ("2bit-code", 285),
    ("2bit-mixed-finetuned", 330),
]
FIXTURE_ATTEMPTS = 20
NL = "\n"


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View A: one row per (model, quantization, language, problem, attempt).

    Grid expansion is a chain of ``explode`` (a Generate node, linear in the
    input), not a join.
    """
    cfg = F.array(*[F.struct(F.lit(q).alias("quantization"), F.lit(t).alias("thr"))
                    for q, t in FIXTURE_THRESHOLDS])
    # the shared hash does not depend on the configuration: compute it once
    # per (model, language, problem, attempt), before the configuration explode
    base = h48(F.concat_ws("|", "model", "language", _s("item_id"), _s("attempt")))
    # spread the few items over tasks before they grow
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = (
        table(spark, sf_dir, "benchmark", "item_id").repartition(tasks, "item_id")
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in FIXTURE_MODELS])))
        .withColumn("language", F.explode(F.array(*[F.lit(x) for x in FIXTURE_LANGUAGES])))
        .withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(FIXTURE_ATTEMPTS - 1))))
        .withColumn("base", base)
        .withColumn("cfg", F.explode(cfg))
        .select("item_id", "model", F.col("cfg.quantization").alias("quantization"),
                "language", "attempt", F.col("cfg.thr").alias("thr"), "base")
    )
    h = h48(F.concat_ws("|", "model", "quantization", "language", _s("item_id"), _s("attempt")))
    df = df.withColumn("h", h)
    h, base = F.col("h"), F.col("base")
    u = (base % 800) + (h % 200)
    status = (F.when(u < F.col("thr"), "OK").when(h % 3 == 0, "Exception")
              .when(h % 3 == 1, "Timeout").otherwise("SyntaxError"))
    exit_code = F.when((u < F.col("thr")) & (h % 50 != 0), 0).otherwise(1).cast("int")
    return df.select(
        "model", "quantization", "language",
        F.concat(F.lit("P_"), _s("item_id")).alias("problem"),
        F.col("attempt").cast("int").alias("attempt"),
        status.alias("status"), exit_code.alias("exit_code"),
    )


def attempts_with_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts plus the 0/1 outcome (the results-CSV shape)."""
    a = attempts(spark, sf_dir)
    return a.withColumn("pass", pass_flag(F.col("status"), F.col("exit_code")))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View B: ordered corpus with Python-dict-literal ``meta`` (code shape)."""
    d = F.col("doc_id")
    path = (F.when(d % 5 == 0, F.concat(F.lit(", 'path': 'src/A"), _s(d), F.lit(".java'")))
            .when(d % 5 == 1, F.concat(F.lit(", 'path': 'lib/m"), _s(d), F.lit(".py'")))
            .when(d % 5 == 2, F.concat(F.lit(", 'path': 'x"), _s(d), F.lit(".js'")))
            .when(d % 5 == 3, F.lit(""))
            .when(d % 25 == 4, F.lit(", 'path': 'py'"))
            .otherwise(F.lit(", 'path': 'T.JAVA'")))
    meta = F.when(d % 13 == 0, F.lit("not a dict")).otherwise(F.concat(
        F.lit("{'source': '"), F.when(d % 11 == 0, "wiki").otherwise("github"),
        F.lit("', 'repo_name': 'repo"), _s((d * 7) % 61), F.lit("'"), path, F.lit("}")))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        d.alias("pos"), "text", meta.alias("meta"))


def qa_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View C: ordered Q&A corpus (stack-exchange shape)."""
    d = F.col("doc_id")
    text = F.concat(F.col("text"), F.when(d % 3 == 0, " python")
                    .when(d % 7 == 0, " JavaScript").otherwise(""))
    meta = F.concat(
        F.lit("{'source': '"), F.when(d % 17 == 0, "wiki").otherwise("stackexchange"),
        F.lit("', 'language': '"), F.col("lang"), F.lit("', 'url': 'https://"),
        F.when(d % 4 == 0, "math.example").otherwise("stackoverflow.com"),
        F.lit("/questions/"), _s(d), F.lit("'"),
        F.when(d % 9 == 0, F.lit("")).otherwise(
            F.concat(F.lit(", 'question_score': '"), _s((d * 37) % 41), F.lit("'"))),
        F.lit("}"))
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang").select(
        d.alias("pos"), text.alias("text"), meta.alias("meta"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View D: generated-id rows: ``doc_id % 4`` pad ids (0), BOS (1), then the
    length of every word of the whole text (two-letter words give EOS = 2)."""
    d = F.col("doc_id")
    lengths = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0),
                          lambda w: F.length(w))
    ids = F.concat(F.array_repeat(F.lit(0), (d % 4).cast("int")), F.array(F.lit(1)), lengths)
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        d, ids.cast("array<int>").alias("ids"))


def code_completions(spark: SparkSession, sf_dir: str, language: str = "py") -> DataFrame:
    """View E: (item_id, attempt, language, prompt, completion), code around the
    whole text of each benchmark item: signatures closed at the margin, strings
    and comments that hold line ends, brackets and braces, code after the first
    function; every fourth problem has no function in its prompt."""
    i, a = F.col("item_id"), F.col("attempt")
    text = F.translate("text", "\"'\\", "")
    line = F.split_part(text, F.lit(NL), F.lit(1))
    fill = lambda s: F.concat(*[{"I": _s(i), "A": _s(a), "T": text, "L": line}.get(p, F.lit(p)) for p in s.split("$")])
    bare, kind = i % 4 == 3, (i + a) % 3
    if language == "py":
        prompt = F.when(bare, fill("x = $I$  # $L$\n")).otherwise(fill('def f$I$(\n    x,  # $L$)\n):\n    """$T$\n    """\n'))
        body = F.when(bare, fill("y = x\n# def no():\n")).otherwise(
            fill('    y = """$T$\ndef no():\n"""  # "not the end\n    z = [\n$A$\n]\n# a note at the margin\n    return y, z\n'))
        tail = F.when(kind == 0, "").when(kind == 1, "\ndef extra():\n    pass\n").otherwise('# after\nprint("""\ndef no(): pass\n""")\n')
    else:
        prompt = F.when(bare, fill("class P$I$ {\n    int v = $I$;\n")).otherwise(
            fill('class P$I$ {\n    // $L$ {\n    static final String A = "} {";\n    P$I$() { this(1); }\n'
                 "    public static <T> String f(\n        int x, char c\n    ) throws Exception {\n"))
        body = F.when(bare, fill("    int w = $A$;")).otherwise(
            fill('        /* } $T$ */\n        String s = "}" + \'}\';\n        if (x > $A$) { return s; }\n        return "";\n    }'))
        tail = F.when(kind == 0, "\n}\n").when(kind == 1, "\n\n    static int g() { return 1; }\n}\n").otherwise("\n    // more }\n}\n")
    return (table(spark, sf_dir, "benchmark", "item_id", "text")
            .withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .select("item_id", F.col("attempt").cast("int").alias("attempt"), F.lit(language).alias("language"),
                    prompt.alias("prompt"), F.concat(body, tail).alias("completion")))


def reply_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View F: each assistant turn with the preceding user turn as prompt.

    Equi-join on (conv_id, turn): a long conversation spreads over many
    partitions instead of sitting in one window partition.
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("completion"))
    user = conv.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return asst.join(user, ["conv_id", "turn"], "inner").select(
        "conv_id", "turn", "prompt", "completion")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View G input: labels joined to the document language."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return labels.join(docs, "doc_id", "inner")
