"""Licences, toxicity, URL filter, quality rules, mixing, token counts."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from calibspark.llm import licenses, mixing, quality, token_counts, toxicity, url_filter
from calibspark.llm.license_texts import KNOWN_TEXTS, MIT
from tests.conftest import SF_MID
from tests.llm.helpers import docs_frame, prose


# ---------------------------------------------------------------- licences
def test_licence_variants(spark):
    variants = ["Copyright (c) 2020 A. Person\n\n" + MIT, MIT.upper(), MIT.replace("\n", " ").replace('"', "'").replace(",", " ;"),
                "# (C) 2001-2004 Someone\nAll rights reserved.\n" + MIT.replace("sublicense", "sub-licence"), MIT + " And more.", "", None]
    out = licenses.scan_licenses(docs_frame(spark, list(enumerate(variants))), licenses.license_digests(licenses.known_licenses(spark)))
    assert {r.doc_id: r.license for r in out.collect()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None}


def test_every_known_text_is_found(spark):
    docs = docs_frame(spark, [(i, t) for i, (_, t) in enumerate(KNOWN_TEXTS)])
    out = licenses.scan_licenses(docs, licenses.license_digests(licenses.known_licenses(spark))).collect()
    assert {r.doc_id: r.license for r in out} == {i: n for i, (n, _) in enumerate(KNOWN_TEXTS)}


def test_neighbouring_spellings_are_all_replaced(spark):
    df = spark.createDataFrame([("Licence licence LICENCE, per cent & whilst",)], "t string")
    assert df.select(licenses.canonical(F.col("t"))).first()[0] == "license license license percent and while"


# ---------------------------------------------------------------- toxicity
def toxic_corpus(n):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 40).split()
        junk, toxic = int(rng.random() < 0.2), int(rng.random() < 0.3)
        words += ["zorkly", "grumpfed"] * toxic + ["%%%"] * junk + ["qqjunk"] * junk
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - junk, toxic))
    return rows, labels


def test_held_out_accuracy_and_chain(spark):
    rows, labels = toxic_corpus(600)
    docs = docs_frame(spark, rows)
    train = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    model = toxicity.train_chain(docs, train)
    assert {c for c, f, _ in model if f.startswith("p:")} == {1, 2}  # later models are fed
    scored = {r.doc_id: r for r in toxicity.score_chain(docs, model).collect()}
    held = labels[400:]
    assert np.mean([(scored[i].p_toxic >= 0.5) == bool(t) for i, _, t in held]) > 0.97
    assert np.mean([(scored[i].p_low_quality >= 0.5) == (not q) for i, q, _ in held]) > 0.97
    assert np.mean([(scored[i].p_toxic_prose >= 0.5) == bool(t and q) for i, q, t in held]) > 0.9


def test_chain_feeds_out_of_fold_probabilities(monkeypatch):
    seen = []
    fit = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, dense, y: seen.append(dense.copy()) or fit(x, dense, y))
    rng = np.random.default_rng(0)
    words = [[f"w{j}" for j in rng.choice(30, 8, replace=False)] for _ in range(80)]
    y = rng.integers(0, 2, (80, 2))  # labels that the words can't tell
    toxicity.fit_chain(words, y, np.arange(80) % 4, min_docs=1)
    fed = seen[-1][:, 0]
    own = toxicity.sigmoid(8 * (y[:, 0] - 0.5))
    assert seen[0].shape[1] == 0 and fed.shape == (80,)
    assert abs(np.corrcoef(fed, own)[0, 1]) < 0.5  # not the in-sample fit


def test_gradient_steps_reach_the_optimum():
    rng = np.random.default_rng(3)
    x = toxicity.Sparse([rng.choice(20, 6, replace=False) for _ in range(2000)], 20)
    y = (x.dot(np.linspace(-2, 2, 20)) + rng.normal(0, 1, 2000) > 0).astype(float)
    w, _, b = toxicity.fit_logistic(x, np.zeros((2000, 0)), y, steps=5000)
    scale = np.where(toxicity.telling(x, y), toxicity.log_ratio(x, y), 0)
    scale /= np.abs(scale).max()
    err = toxicity.sigmoid(x.dot(w) + b) - y
    used = scale != 0
    assert np.abs(x.tdot(err)[used] * scale[used] + toxicity.REG * (w[used] / scale[used])).max() < 1e-2 and abs(err.sum()) < 1e-2


def test_planted_toxic_documents(spark):
    """Documents of the given table that hold at least three of the insults; clean ones stay clean."""
    insults = set("loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())
    out = {r.doc_id: r.toxic for r in toxicity.op3_toxicity_chain(spark, SF_MID).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").where("lang = 'en'").collect()}
    n = {i: len(insults & toxicity.features(t)) for i, t in texts.items()}
    assert np.mean([out[i] for i in n if n[i] >= 3]) > 0.95
    assert np.mean([out[i] for i in n if n[i] == 0]) < 0.01


# ---------------------------------------------------------------- urls
@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/#f", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/?a://b", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com?u=/de/", "x.com", "", None, None),
    ("http://org", "org", "", None, None),
    ("ftp://ÀB.com:8/ÀB", "Àb.com:8", "/ÀB", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("mailto:x", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
])
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    h, p = url_filter.url_parts(F.col("u"))
    df = spark.createDataFrame([(url,)], "u string").select(h.alias("h"), p.alias("p"))
    r, v = url_filter.rule_of(F.col("h"), F.col("p"))
    assert tuple(df.select("h", "p", r, v).first()) == (host, path, rule, verdict)


def test_query_equals_sql_where_a_rule_fits(spark):
    """Host, path, rule and the rules' verdicts of the whole query, by SQL of its own."""
    got = {r.page_id: r for r in url_filter.op6_url_filter(spark, SF_MID).collect()}
    want = duckdb.sql(f"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM '{SF_MID}/pages.parquet'),
        r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p, rules
              WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT page_id, host, path, rule, v FROM p LEFT JOIN fit USING (page_id)""").fetchall()
    assert len(want) == len(got)
    for page, host, path, rule, verdict in want:
        row = got[page]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict == ("block" if row.p_block >= 0.5 else "allow")
    assert len({r[3] for r in want}) > 3 and {"allow", "block"} == {r[4] for r in want if r[4]}


def test_url_model_on_held_out_urls_and_by_brute_force(spark):
    labelled = url_filter.labelled_urls(spark)
    model = url_filter.fit_url_model(labelled)
    urls = [("http://free-casino-slots.example/bonus", 1), ("http://cheap-viagra-pills.example/buy", 1), ("http://xxx-cams.example/live", 1),
            ("https://library.example/history/book/3", 0), ("https://www.science.example/article/river", 0), ("https://city.example/news/council", 0)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, model).collect()}
    assert [out[i].verdict for i in range(6)] == ["block" if y else "allow" for _, y in urls]
    # the optimum of the regularised loss, by Newton steps on the same features
    rows = url_filter.featurise(labelled, "url", 1 << 14).select("features", "label").collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows], float)
    used = x.any(0)
    x = np.column_stack([x[:, used], np.ones(len(y))])
    w, pen = np.zeros(x.shape[1]), np.append(np.full(used.sum(), 0.02), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(pen + 1e-12)
        w -= np.linalg.solve(hess, x.T @ (p - y) / len(y) + pen * w)
    test = np.array([r.features.toArray() for r in url_filter.featurise(pages, "url", 1 << 14).orderBy("page_id").collect()])
    z = np.column_stack([test[:, used], np.ones(6)]) @ w
    assert np.allclose([out[i].p_block for i in range(6)], 1 / (1 + np.exp(-z)), atol=2e-3)


# ---------------------------------------------------------------- quality
def words_of(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def base_by_hand(text):
    w = words_of(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    at = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at))


def test_base_statistics(spark):
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z q x y z y z q", "l1\nl1\n\n \nl2\nl1 ", "# * $%&|<>", "a\u00a0b\u2003c d",
             "é ü\x0bñ\x0c#", "same words again " * 200, prose(3, 300), (prose(4, 30) + "\n") * 4]
    got = {r.doc_id: tuple(r)[1:6] for r in quality.quality_verdicts(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: base_by_hand(t) for i, t in enumerate(texts)}


def quality_rows():
    menu = "Home About Contact and a few more words of the site's menu line here"
    rows = []
    for i in range(40):
        rows.append((i, menu.upper() + "\n" + prose(i, 80), "big"))  # loses the menu only
        rows.append((100 + i, menu + "\n" + prose(1000 + i, 45), "big"))  # depleted by it
        rows.append((200 + i, prose(2000 + i, 90), "big"))
        rows.append((300 + i, prose(7, 90), "copies"))  # copies count once
    rows += [(400 + i, menu + "\n" + prose(3000 + i, 45), "small") for i in range(5)]
    return rows


def test_frequent_lines_and_depletion(spark):
    out = {r.doc_id: r for r in quality.quality_verdicts(docs_frame(spark, quality_rows())).collect()}
    assert all(out[i].kept and out[i].removed_words == 14 for i in range(40))
    assert all(not out[100 + i].kept and not out[100 + i].base_failed for i in range(40))
    assert all(out[i].kept and not out[i].removed_words for i in [*range(200, 240), *range(300, 340), *range(400, 405)])


def test_limit_of_large_hosts(spark):
    """A line below the share goes above the absolute limit, and only there."""
    menu = "one line of words that a few documents of a large host share"
    rows = [(i, menu + "\n" + prose(i, 45), "big") for i in range(25)] + [(100 + i, prose(500 + i, 60), "big") for i in range(275)]
    docs = docs_frame(spark, rows)
    at = {n: {r.doc_id: r for r in quality.quality_verdicts(docs, max_docs=n).collect()} for n in (24, 25)}
    assert all(at[24][i].removed_words == 13 and not at[24][i].kept for i in range(25))
    assert all(at[25][i].removed_words == 0 and at[25][i].kept for i in range(25))
    assert all(at[n][100 + i].kept for n in at for i in range(275))


@pytest.mark.parametrize("max_docs", [24, 25, 100_000])
def test_verdicts_equal_sql_where_lines_go(spark, max_docs):
    rows = quality_rows() + [(1000 + i, "a line that fewer documents of the host than its share hold\n" + prose(4000 + i, 45), "wide") for i in range(25)]
    rows += [(2000 + i, prose(5000 + i, 60), "wide") for i in range(275)]
    docs = docs_frame(spark, rows)
    got = quality.quality_verdicts(docs, max_docs=max_docs).toPandas()
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.execute(quality.oracle(max_docs=max_docs)).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
    assert (got.removed_words > 0).sum() == 80 + 25 * (max_docs == 24) and not got.kept.all()


def test_filter_applies_the_verdicts(spark):
    docs = docs_frame(spark, quality_rows())
    kept = {r.doc_id: r for r in quality.filter_documents(docs).collect()}
    assert set(kept) == {r.doc_id for r in quality.quality_verdicts(docs).collect() if r.kept}
    assert kept[3].text == prose(3, 80) and kept[3].n_chars == len(kept[3].text)
    assert kept[401].text.startswith("Home About") and kept[401].n_chars == len(kept[401].text)


# ---------------------------------------------------------------- mixing
def mix_rows():
    return [(i, prose(i, 20 + i % 7), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(900)] + [(1000, "", "empty"), (1001, None, None)]


@pytest.mark.parametrize("n", [49, 98, 103])
def test_least_repeated_source_is_whole_at_large_counts(spark, n):
    """Rounding of doubles takes no token off the source that is used once."""
    rows = [(f"s{i}", 10 ** 12 + 7 - i, 1) for i in range(n)]
    sources = spark.createDataFrame(rows, "source string, tokens long, n_docs long")
    least = mixing.mixing_weights(sources, max_repeats=None).where("source = 's0'").first()
    assert least.budget == least.tokens == 10 ** 12 + 7


def test_exponent_meets_the_limits(spark):
    docs = docs_frame(spark, mix_rows())
    sources = mixing.source_tokens(docs.select(F.coalesce("source", F.lit("")).alias("source"), F.size(F.split("text", " ")).cast("long").alias("tokens")))
    tokens = np.array([r.tokens for r in sources.collect() if r.tokens and r.tokens > 0], float)
    share = tokens / tokens.sum()
    for limit in (1.2, 1.5, 2.0):
        w = mixing.mixing_weights(sources, max_repeats=limit).collect()
        alpha = w[0].alpha
        assert abs((share.max() / share.min()) ** (1 - alpha) - limit) < 1e-3 or alpha == 0
        assert abs(sum(r.weight for r in w) - 1) < 1e-9
    target = 1.2
    alpha = mixing.mixing_weights(sources, target_entropy=target, max_repeats=None).first().alpha
    p = share ** alpha / (share ** alpha).sum()
    assert abs(-(p * np.log(p)).sum() - target) < 1e-3 or alpha in (0, 1)


def test_budgets_are_met_by_whole_blocks_and_nothing_is_lost(spark):
    docs = docs_frame(spark, mix_rows())
    out = mixing.temperature_mix(docs).collect()
    draws = Counter(r.doc_id for r in out)
    assert set(draws) == {r[0] for r in mix_rows()} and max(draws.values()) <= math.ceil(mixing.MAX_REPEATS)
    tokens = {r[0]: len(words_of(r[1])) for r in mix_rows()}
    of = {r[0]: r[2] or "" for r in mix_rows()}
    total, drawn = Counter(), Counter()
    for i, n in tokens.items():
        total[of[i]] += n
    for i, n in draws.items():
        drawn[of[i]] += n * tokens[i]
    share = {s: t / sum(total.values()) for s, t in total.items() if t}
    alpha = 1 - math.log(mixing.MAX_REPEATS) / math.log(max(share.values()) / min(share.values()))
    budget = {s: (max(share.values()) / p) ** (1 - max(alpha, 0)) * total[s] for s, p in share.items()}
    biggest = max(tokens.values()) * 12  # a block's tokens, generously
    assert all(budget[s] - biggest <= drawn[s] <= budget[s] + 1 for s in share)
    first = [r for r in out if r.epoch == 0]
    assert len(first) == len(mix_rows()) and all(0 <= r.mix_key < 1 for r in out)


def test_query_by_brute_force(spark):
    """Exponent, weights, budgets and every drawn (document, epoch, block, rank) of the whole query."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = sorted(map(tuple, mixing.op7_temperature_mix(spark, SF_MID).select("doc_id", "source", "epoch", "block", "block_rank").collect()))
    block = F.pmod(mixing.order_of(F.col("doc_id")), F.lit(mixing.BLOCKS)).cast("int")
    rows = [(d, s, b, len([w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w]))
            for d, s, b, t in docs.select("doc_id", F.coalesce("source", F.lit("")), block, "text").collect()]
    tokens, size = Counter(), Counter()
    for _, s, b, n in rows:
        tokens[s] += n
        size[s, b] += n
    total = sum(tokens.values())

    def power(alpha):
        return {s: (n / total) ** alpha for s, n in tokens.items() if n}

    steps = 1 << mixing.STEPS
    fits = [k for k in (0, *range(1, steps, steps // 4096), steps)
            if max(p / tokens[s] for s, p in power(k / steps).items()) <= mixing.MAX_REPEATS * min(p / tokens[s] for s, p in power(k / steps).items())]
    counted = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    sources = spark.createDataFrame([(s, n) for s, n in tokens.items()], "source string, tokens long").join(counted, "source")
    weights = {r.source: r for r in mixing.mixing_weights(sources).collect()}
    alpha = next(iter(weights.values())).alpha
    assert fits[0] - steps // 4096 <= alpha * steps <= fits[0]
    p = power(alpha)
    most = max(tokens[s] / x for s, x in p.items())
    want = []
    keys = [(s, e, b) for s, b in size for e in range(4)]
    order = {tuple(r)[:3]: r.k for r in spark.createDataFrame(keys, "s string, e int, b int")
             .select("s", "e", "b", mixing.order_of(F.col("s"), F.col("e"), F.col("b")).alias("k")).collect()}
    by_block = {}
    for d, s, b, _ in rows:
        by_block.setdefault((s, b), []).append(d)
    for s, n in tokens.items():
        budget = weights[s].budget
        if n:
            assert abs(budget - p[s] * most) <= 1 and abs(weights[s].weight - p[s] / sum(p.values())) < 1e-12
        for epoch in range(budget // n + 1 if n else 1):
            spent = epoch * n
            for rank, b in enumerate(sorted((b for x, b in size if x == s), key=lambda b: (order[s, epoch, b], b)), 1):
                spent += size[s, b]
                if not n or epoch < budget // n or spent <= budget:
                    want += [(d, s, epoch, b, rank) for d in by_block[s, b]]
    assert got == sorted(want) and len({r[1] for r in want}) > 5


def test_small_budget_and_other_limits(spark):
    docs = docs_frame(spark, mix_rows()[:900])
    out = mixing.temperature_mix(docs, budget=3000, blocks=64).collect()
    tokens = {r[0]: len(words_of(r[1])) for r in mix_rows()}
    assert 2000 < sum(tokens[r.doc_id] for r in out) <= 3000


# ---------------------------------------------------------------- token counts
def viterbi(word, scores, byte_score):
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        found = [(best[b][0] + scores[word[b:e]], -(best[b][1] + 1)) for b in range(max(0, e - 40), e) if word[b:e] in scores]
        if word[e - 1] not in scores:
            n = len(word[e - 1].encode("utf-8", "surrogatepass"))
            found.append((best[e - 1][0] + n * byte_score, -(best[e - 1][1] + n)))
        top = max(found)
        best[e] = (top[0], -top[1])
    return best[-1][1]


def test_trie_counts_equal_word_by_word_counts(spark):
    scores = token_counts.piece_scores(token_counts.load_pieces())
    counter = token_counts.TrieCounter(scores)
    words = {token_counts.MARK + w for r in spark.read.parquet(f"{SF_MID}/documents.parquet").limit(60).collect() for w in r.text.split()}
    words |= {"▁", "▁日本語", "▁\U0001f600x\U0001f600", "▁" + "abcab" * 300, "▁aaaaaaaaaa", "▁a", "▁ab", "▁abc"}
    got = counter.counts(words)
    assert got == {w: viterbi(w, scores, counter.byte_score) for w in words}


def test_shared_prefixes_are_computed_once(monkeypatch):
    counter, calls = token_counts.TrieCounter({"a": -1.0, "b": -1.5, "ab": -1.2}), []
    node = counter._node
    monkeypatch.setattr(counter, "_node", lambda w, e, *a: calls.append(w[:e]) or node(w, e, *a))
    assert counter.counts(["abab", "aba", "abb", "ab"]) == {"abab": 2, "aba": 2, "abb": 2, "ab": 1}
    assert sorted(calls) == ["a", "ab", "aba", "abab", "abb"]  # the trie's nodes


def test_counts_add_up(spark):
    texts = [None, "", "  \n", "hello world", "hello hello", "hello"]
    out = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs_frame(spark, list(enumerate(texts))), token_counts.load_pieces()).collect()}
    assert out[0] == out[1] == out[2] == (0, 0) and out[4] == (2, 2 * out[5][1]) and out[3][0] == 2
