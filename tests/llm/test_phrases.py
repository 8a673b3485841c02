"""Phrases against a brute-force count over texts, in small parts and blocks too."""

import re
from collections import Counter

import numpy as np
import pytest

from calibspark.llm import blocks as B
from calibspark.llm import phrases as P
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_rows


def brute(rows, min_count=30, top=2000):
    """Rows of the query from (lang, text) pairs."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        rows = []
        for g, a in cand.items():
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            held = any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                       for h, b in cand.items())
            if not held:
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, id string")


@pytest.mark.parametrize("part,block", [(1 << 20, 5 << 20), (100, 10_000)])
def test_query_equals_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "QUESTIONS", part)
    monkeypatch.setattr(B, "SAMPLE", 1024 if part > 1000 else 8)
    monkeypatch.setattr(B, "BLOCK", block)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows)
    assert len({len(r[2].split(" ")) for r in want}) > 1
    assert {tuple(r) for r in P.op12_phrase_collocations(spark, SF_SMALL).collect()} == want


def test_planted_phrases_ties_and_languages(spark):
    rng = np.random.default_rng(3)
    noise = [f"n{i}" for i in range(40)]
    rows = [(lang, f"{' '.join(rng.choice(noise, 8))}, New York City hall. " + ("big apple pie;" if k % 2 else "big apple; apple pie") + " ha ha ha ha ha")
            for k in range(50) for lang in ("en", None, "und", "")]
    got = {tuple(r) for r in P.collocations(frame(spark, rows)).collect()}
    assert got == brute(rows)
    phrases = {(r[0], r[2]) for r in got}
    assert ("en", "new york city hall") in phrases and ("en", "new york") not in phrases and ("und", "ha ha ha ha") in phrases
    assert max(r[3] for r in got if r[0] == "und" and r[2] == "new york city hall") == 100


def test_rank_limit(spark):
    rows = [("en", ". ".join(f"a{i} b{i}" for i in range(30))) for _ in range(31)]
    got = sorted(P.collocations(frame(spark, rows), top=7).collect(), key=lambda r: r.rank)
    assert {tuple(r) for r in got} == brute(rows, top=7) and len(got) == 7


def test_edge_rows(spark):
    rows = [(lang, t) for _, t, *_ in edge_rows() for lang in ("en", None)] + [("en", "a b. c d\x0be f"), ("en", "a\tb"), ("en", "ÉA b")] * 30
    assert {tuple(r) for r in P.collocations(frame(spark, rows), min_count=2).collect()} == brute(rows, 2)


def test_tiles_are_counted_alike():
    """Dense and sparse tiles, with and without counts, at the margin of the direct-address grid too."""
    rng = np.random.default_rng(0)
    left, right = (np.concatenate([rng.integers(0, 600, 4000), rng.integers(0, 60_000, 1000), np.full(500, 32_300), [2 ** 31 - 1]]) for _ in range(2))
    codes = P.cell_codes(left, right)
    want = Counter(zip(left.tolist(), right.tolist()))
    for dense in (1, 300, 1 << 40):
        got, counts = P.count_tiles(codes, dense=dense)
        assert (np.diff(got) > 0).all() and counts.sum() == len(codes)
        again, sums = P.count_tiles(np.concatenate([got, got]), np.concatenate([counts, 2 * counts]), dense=dense)
        assert (again == got).all() and (sums == 3 * counts).all()
        assert dict(zip(got.tolist(), counts.tolist())) == {int(P.cell_codes(np.array(a), np.array(b))): n for (a, b), n in want.items()}


def test_too_many_ids_are_an_error(spark):
    from pyspark.errors import PySparkException
    with pytest.raises(PySparkException):
        P.checked(spark.range(1 << 31, (1 << 31) + 1)).collect()
