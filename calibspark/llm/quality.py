"""Quality rules: base statistics of a document, and cross-document line
frequency.

Lines are normalised and hashed, the distinct documents (by text: exact copies
count once) that hold a line are counted per host, lines above the limit are
removed, and documents depleted by that are rejected.  ``source`` is the host
of ``documents``.  DataFrame functions only.

Work: one scan of the texts gives the base statistics, one gives the skinny
line table; only hashes and counts are shuffled.  The hot line or host is
counted with partial aggregation, and the joins are between written tables, so
the adaptive skew join can split a hot key.

Defined results: a null text has no words and fails the base rules; a null
source counts as the host ``''``; repeated rows and equal texts of one host get
equal verdicts; an empty table gives an empty result; only the named columns
are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.functions.code import let
from calibspark.llm.scratch import materialise, words

SPACE = r"[\x20\x09-\x0D]"

#: A line is removed where over MIN_DOCS distinct documents of its host hold it, and these are over SHARE of
#: them or over MAX_DOCS: on a host of millions a line in a tenth of the documents less one is boilerplate too.
MIN_DOCS, SHARE, MAX_DOCS = 20, 0.1, 100_000
#: A document is depleted with fewer than MIN_WORDS words left, or less than KEEP of its words.
MIN_WORDS, KEEP = 50, 0.5


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed; the text column is kept.

    Repeated 3-word windows are found by hashing the windows, sorting the
    hashes, and, only where two are equal, sorting (hash, start) once more to
    get the starts; a repeated window covers its three words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"__w": words(text_col), "__lines": lines})
    w, n = F.col("__w"), F.size("__w")
    df = df.select(*docs.columns, n.cast("long").alias("n_words"),
                   F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                   (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                   (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                   repeat_words(w).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def repeat_words(words_col: Column) -> Column:
    """Words in 3-word windows found twice or more.  Every array is bound
    once (``let``), so that a filter on the result, which the optimizer moves
    below the projections, doesn't build it again for each window."""
    empty = F.array().cast("array<bigint>")

    def hashes(w):
        n = F.size(w)
        return F.when(n >= 3, F.transform(F.arrays_zip(F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"),
                                                       F.slice(w, F.lit(3), n - 2).alias("c")),
                                          lambda s: F.xxhash64(s["a"], s["b"], s["c"]))).otherwise(empty)

    def covered(p):
        twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                           lambda a: a["n"])

    def count(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), let(pairs, covered)).otherwise(F.lit(0))

    return let(words_col, lambda w: let(hashes(w), count))


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))


def text_key(col: str = "text") -> Column:
    """128-bit digest of a text; equal texts of one host share their verdict."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
                   share: float = SHARE, max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): ``lines`` (host, key, line, words) is each distinct
    text's distinct lines with the words they hold, ``frequent`` (host, line,
    n_docs) the lines above the limit of their host."""
    host = F.coalesce(F.col(host_col), F.lit(""))
    rows = docs.select(host.alias("host"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    lines = (rows.select("host", "key", F.explode(F.split("text", "\n")).alias("l"))
             .select("host", "key", F.xxhash64(normal_line(F.col("l"))).alias("line"),
                     F.size(words("l")).cast("long").alias("words")).where("words > 0"))
    copies = materialise(rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies")), "copies")
    # copies of a text add up in the sum, so it is divided by their number
    summed = lines.groupBy("host", "key", "line").agg(F.sum("words").alias("all_words"))
    lines = materialise(summed, "lines")
    per_host = copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    frequent = materialise(counted.join(per_host, "host")
                           .where((F.col("n_docs") > share * F.col("host_docs")) | (F.col("n_docs") > max_docs))
                           .select("host", "line", "n_docs"), "frequent")
    hit = (lines.join(frequent, ["host", "line"], "left_semi")
           .join(copies, ["host", "key"])
           .select("host", "key", "line", (F.col("all_words") / F.col("copies")).cast("long").alias("words")))
    return hit, frequent


def removed_by_text(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
                    share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, key, removed_words, removed_lines): what each text loses;
    ``removed_lines`` is an array of line hashes, no longer than the text has lines."""
    hit, _ = frequent_lines(docs, host_col, text_col, min_docs, share, max_docs)
    return materialise(hit.groupBy("host", "key").agg(F.sum("words").alias("removed_words"),
                                                      F.collect_list("line").alias("removed_lines")), "removed")


def kept_verdict(min_words: int = MIN_WORDS, keep: float = KEEP) -> Column:
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < keep * F.col("n_words")))
    return ~F.col("base_failed") & ~depleted


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                     min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS,
                     keep: float = KEEP, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per row of ``docs``: base statistics, words removed with
    frequent lines, and the verdict."""
    removed = removed_by_text(docs, host_col, text_col, min_docs, share, max_docs).drop("removed_lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                       F.col(text_col).alias("text"), text_key(text_col).alias("key"))
    rows = base_statistics(rows).drop("text")
    return (rows.join(removed, ["host", "key"], "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "removed_words", kept_verdict(min_words, keep).alias("kept")))


def filter_documents(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents that stay, without their frequent lines; all columns of
    ``docs``, ``n_chars`` counted anew where a line went."""
    removed = removed_by_text(docs, "source", "text", min_docs, share, max_docs)
    # the row travels as one struct, so that no column of it can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("source", F.lit("")).alias("host"),
                       text_key().alias("key"), F.col("text").alias("text"))
    rows = (base_statistics(rows).where(~F.col("base_failed")).join(removed, ["host", "key"], "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0))).where(kept_verdict()))
    gone = F.col("removed_lines")
    left = F.array_join(F.filter(F.split("text", "\n"),
                                 lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n")
    rows = rows.withColumn("left", F.when(gone.isNull(), F.col("text")).otherwise(left))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone.isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long"))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, keep: float = KEEP,
           max_docs: int = MAX_DOCS) -> str:
    sp = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{sp}+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY r),
base AS (SELECT w.r, doc_id, host, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
      length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
texts AS (SELECT DISTINCT host, t FROM d),
raw AS (SELECT host, t, unnest(string_split(t, chr(10))) AS l FROM texts),
lines AS (SELECT host, t, lower(trim(regexp_replace(l, '{sp}+', ' ', 'g'))) AS line,
      len(list_filter(regexp_split_to_array(l, '{sp}+'), lambda x: x <> '')) AS n FROM raw),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM lines WHERE n > 0 GROUP BY ALL)
      JOIN (SELECT host, count(*) AS h FROM texts GROUP BY host) USING (host) WHERE n > {min_docs} AND (n > {share} * h OR n > {max_docs})),
gone AS (SELECT host, t, sum(n) AS g FROM lines SEMI JOIN freq USING (host, line) GROUP BY ALL),
j AS (SELECT base.*, coalesce(g, 0) AS removed_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM base LEFT JOIN gone USING (host, t))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  CAST(removed_words AS BIGINT) AS removed_words,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {min_words} OR n_words - removed_words < {keep} * n_words)) AS kept
FROM j"""
