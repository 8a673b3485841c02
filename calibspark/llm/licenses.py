"""Licence scan by canonical digest.

Whole texts are brought to one canonical form (case, copyright lines,
punctuation, equivalent spellings), digested, and hash-joined to the digests
of known licence texts.  JVM-side expressions only.

Defined results: a null text counts as empty; an empty canonical form matches
no licence; repeated rows match alike, one row out per row in; an empty table
gives an empty result; other columns are not read.  If two known texts have
one canonical form, the smaller licence name stands for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.license_texts import KNOWN_TEXTS

#: Equivalent spellings, replaced as whole words (or runs of words) in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]


#: A line that is a copyright notice with a year, or "all rights reserved".
NOTICE = r"^[ \t#*/;-]*((copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|all rights reserved\.?[ \t]*)$"


def canonical(text: Column, spellings=SPELLINGS) -> Column:
    """Canonical form: lower case; lines that start with a copyright notice or
    "all rights reserved" are dropped; ``&`` is "and"; every other run of
    characters that are not letters or digits is one space; equivalent
    spellings are replaced as whole words."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "(?md)" + NOTICE, " ")
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    # every word gets a space of its own on either side, so that neighbours can both be replaced
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for a, b in spellings:
        if a != b:
            t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def license_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of a table (license, text)."""
    c = canonical(F.col("text"))
    return (known.select("license", c.alias("c")).where("c <> ''")
            .groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license")))


def scan_licenses(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its canonical digest and the licence whose
    whole text it is, else null.

    Only digests meet in the join.  A hot digest (a licence that a third of the
    rows repeat) is split by the adaptive skew join, or doesn't move at all
    where the known side is small enough for Spark to broadcast it.
    """
    c = canonical(F.col(text_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), c.alias("c"))
            .select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest")))
    return rows.join(digests, "digest", "left").select("doc_id", "canonical_chars", "digest", "license")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_TEXTS, "license string, text string")


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, license_digests(known_licenses(spark)))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str, spellings=SPELLINGS) -> str:
    """DuckDB twin of ``canonical``."""
    t = f"regexp_replace(lower(coalesce({text}, '')), '(?m){NOTICE}', ' ', 'g')"
    t = f"replace({t}, '&', ' and ')"
    t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in spellings:
        if a != b:
            t = f"replace({t}, {_sql_text(' ' + a.replace(' ', '  ') + ' ')}, {_sql_text(' ' + b.replace(' ', '  ') + ' ')})"
    return f"trim(replace({t}, '  ', ' '), ' ')"


def oracle() -> str:
    known = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN_TEXTS)
    return f"""
WITH known(license, body) AS (VALUES {known}),
digests AS (SELECT sha256({canonical_sql('body')}) AS digest, min(license) AS license FROM known
            WHERE {canonical_sql('body')} <> '' GROUP BY 1),
d AS (SELECT doc_id, {canonical_sql('text')} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS digest, license
FROM d LEFT JOIN digests ON sha256(d.c) = digests.digest"""
