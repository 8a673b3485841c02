"""Order MinHash, alignment, components, decontamination, repeated passages, pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as P
from calibspark.llm import alignment, decontaminate, order_minhash, repeats
from calibspark.llm.components import components
from calibspark.llm.wordhash import word_hashes
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import docs_frame, prose


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def altered(words, share, rng):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out += [f"new{rng.randrange(10 ** 6)}"] if r < 2 * share / 3 else [w, f"ins{rng.randrange(10 ** 6)}"] if r < share else [w]
    return out


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    pairs, limits, want = [], [], []
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        b = altered(a, rng.random(), rng) if rng.random() < 0.7 else [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        b = [hash(x) % 1000 for x in b]
        limit = rng.randrange(0, 45)
        d = levenshtein(a, b)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        limits.append(limit)
        want.append(d <= limit)
    assert alignment.within(pairs, limits).tolist() == want and 60 < sum(want) < 240


def test_word_hashes():
    words, n = word_hashes(["The cat, the CAT", None, "", "é-é", "..."])
    assert n.tolist() == [4, 0, 0, 2, 0] and words[0] == words[2] and words[1] == words[3] and words[4] == words[5]
    assert len(set(words.tolist())) == 3


def test_components(spark):
    edges = [(b, b + 1) for b in range(0, 60)] + [(100, 101), (102, 101), (200, 200)] + [(300, i) for i in range(301, 380)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, **{i: 300 for i in range(300, 380)}}


def near_corpus():
    """Texts, and what brute force links: all pairs of similarity 0.8 or more, as components."""
    rng = random.Random(4)
    texts = [prose(i, 60 + i % 90) for i in range(40)]
    for i in range(40):
        words = texts[i].split()
        texts += [" ".join(altered(words, s, rng)) for s in (0.02, 0.05, 0.1)[: 1 + i % 3]]
    shared = prose(999, 30)  # a passage in many otherwise different texts
    texts += [prose(500 + i, 40) + "\n" + shared for i in range(30)]
    texts += [texts[0], texts[0].upper(), texts[1], "", None, "...", "one two", "one two", "one two three four five six seven"]
    return texts


def brute_classes(texts):
    words = [word_hashes([t])[0] for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = max(len(words[i]), len(words[j]))
            close = (texts[i] or "") == (texts[j] or "")
            if not close and n and abs(len(words[i]) - len(words[j])) <= 0.2 * n:
                close = levenshtein(words[i].tolist(), words[j].tolist()) <= 0.2 * n + 1e-9
            if close:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_against_brute_force(spark):
    texts = near_corpus()
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert got == brute_classes(texts)


def test_large_bucket_of_unlike_and_like_texts(spark):
    """Many texts around one passage: few pivots, all classes right."""
    rng = random.Random(9)
    core = prose(77, 120).split()
    texts = [" ".join(altered(core, 0.04, rng)) for _ in range(60)] + [" ".join(core + prose(800 + i, 60 + i).split()) for i in range(60)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert got == brute_classes(texts)


def substituted(words, share, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), round(share * len(out))):
        out[i] = f"sub{rng.randrange(10 ** 9)}"
    return out


def classes_and_links(spark, words):
    """(class by row, rows' sketches) of texts given as words."""
    texts = [" ".join(w) for w in words]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs_frame(spark, list(enumerate(texts)))).collect()}
    hashes, n = word_hashes(texts)
    return got, order_minhash.sketches(hashes, n)


def test_star_of_variants(spark):
    """1,000 variants of one base at about 0.85: all that share a value with the
    base and are linked to it are in its class, whatever pivot they met."""
    rng = random.Random(31)
    base = prose(4100, 300).replace(".", "").split()
    words = [base] + [substituted(base, 0.14 + 0.02 * rng.random(), rng) for _ in range(1000)]
    got, s = classes_and_links(spark, words)
    want = {i for i in range(1, 1001) if (s[i] == s[0]).any()}  # at most 48 of 300 words differ: all are linked
    assert len(want) >= 900
    assert {got[i] for i in want} == {got[0]}


def test_pairs_around_a_template(spark):
    """Pairs of documents that are half a common template: all that share a value are found."""
    rng = random.Random(32)
    template = prose(4200, 150).replace(".", "").split()
    words = [template + prose(10_000 + i, 150, 10 ** 6).replace(".", "").split() for i in range(500)]
    words += [substituted(w, 0.12, rng) for w in words[:200]]
    got, s = classes_and_links(spark, words)
    want = [i for i in range(200) if (s[i] == s[500 + i]).any()]
    assert len(want) >= 195
    assert [i for i in want if got[i] != got[500 + i]] == []
    assert len(set(got.values())) >= 500  # and the template alone links nothing


def test_open_pairs_are_not_rows(spark, monkeypatch):
    """Texts that share buckets and a bag of words, but not its order: every pair is
    aligned, and the tables between stay in proportion to the texts."""
    rows, write = {}, order_minhash.materialise

    def counted(df, name):
        out = write(df, name)
        if name not in ("links", "labels", "step"):
            rows[name] = out.count()
        return out

    monkeypatch.setattr(order_minhash, "materialise", counted)
    rng = random.Random(36)
    template, own = prose(4400, 60).replace(".", "").split(), prose(4401, 60).replace(".", "").split()
    words = [template + rng.sample(own, len(own)) for _ in range(200)]
    words += [substituted(words[i], 0.05, rng) for i in range(5)]
    got, s = classes_and_links(spark, words)
    assert all(got[200 + i] == got[i] for i in range(5) if (s[i] == s[200 + i]).any()) and len(set(got.values())) == 200
    assert 0 < rows["met"] and all(n <= 64 * 205 for n in rows.values())  # no more than texts have values
    assert rows["partnered"] <= 20 * 205


def test_a_pair_belongs_to_one_bucket():
    """Over all buckets that two texts share, their pair is made once."""
    rng = np.random.default_rng(37)
    sketch = rng.integers(1, 4, (40, 6)) + 10 * np.arange(6)
    bag, n, made = np.ones((40, order_minhash.BINS), np.uint8), np.full(40, 300), []
    for i in range(6):
        for value in np.unique(sketch[:, i]):
            at = np.flatnonzero(sketch[:, i] == value)
            earlier = sketch[at, :i], np.full(len(at), i)
            none = np.zeros(len(at), np.int64)
            for a, b in order_minhash.pairs_of_groups(none, none, at, n[at], bag[at], earlier, 0.8):
                made += [(min(x, y), max(x, y)) for x, y in zip(at[a].tolist(), at[b].tolist())]
    assert sorted(made) == [(x, y) for x in range(40) for y in range(x + 1, 40) if (sketch[x] == sketch[y]).any()]


def test_joining_links_join_as_all_links_do(monkeypatch):
    """Links of a block join the classes that all its similar pairs join, and no more than needed."""
    monkeypatch.setattr(order_minhash, "ALIGN_WORDS", 500)
    rng = random.Random(34)
    for trial in range(20):
        bases = [[f"w{trial}x{i}y{k}" for k in range(40)] for i in range(4)]
        words = [np.array([hash(w) & (1 << 62) - 1 for w in altered(bases[rng.randrange(4)], 0.2, rng)], np.uint64) for _ in range(40)]
        pairs = np.array([(x, y) for x in range(40) for y in range(x) if rng.random() < 0.7])
        label = np.array([rng.randrange(15) if rng.random() < 0.5 else 100 + i for i in range(40)])
        got = order_minhash.joining_links(words, pairs[:, 0], pairs[:, 1], label[pairs[:, 0]], label[pairs[:, 1]])
        want = [k for k, (x, y) in enumerate(pairs)
                if levenshtein(words[x].tolist(), words[y].tolist()) <= max(len(words[x]), len(words[y])) * 0.2 + 1e-9]

        def classes(links):
            of = {v: v for v in label.tolist()}
            for k in links:
                x, y = (of[v] for v in label[pairs[k]].tolist())
                of = {v: min(x, y) if c in (x, y) else c for v, c in of.items()}
            return of

        assert set(got.tolist()) <= set(want) and classes(got) == classes(want)
        assert len(got) == len(set(label.tolist())) - len(set(classes(got).values()))


@pytest.mark.parametrize("align", [3, 256])
def test_blocks_of_a_bucket_give_all_classes(spark, monkeypatch, align):
    monkeypatch.setattr(order_minhash, "ALIGN", align)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    rng = random.Random(35)
    base = prose(4300, 120).split()
    texts = [" ".join(altered(base, 0.05 + 0.1 * rng.random(), rng)) for _ in range(80)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert got == brute_classes(texts)


def test_scattered_edits_at_the_threshold_are_found():
    """At a similarity of just 0.8, nine of ten isolated pairs share a value."""
    rng = random.Random(33)
    found = []
    for i in range(600):
        w = prose(20_000 + i, 300, 10 ** 6).replace(".", "").split()
        hashes, n = word_hashes([" ".join(w), " ".join(substituted(w, 0.2, rng))])
        s = order_minhash.sketches(hashes, n)
        found.append(bool((s[0] == s[1]).any()))
    assert np.mean(found) >= 0.9


def test_order_matters():
    a = prose(5, 200).split()
    chunks = [a[i:i + 8] for i in range(0, 200, 8)]
    random.Random(2).shuffle(chunks)
    shuffled = " ".join(w for c in chunks for w in c)
    words, n = word_hashes([" ".join(a), " ".join(a[:190]), shuffled])
    s = order_minhash.sketches(words, n, 256)
    assert (s[0] == s[1]).mean() > 0.75 and (s[0] == s[2]).mean() < (s[0] == s[1]).mean() / 2


def test_keep_one(spark):
    texts = near_corpus()
    docs = docs_frame(spark, list(enumerate(texts)))
    kept = order_minhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts).values()))


# ---------------------------------------------------------------- decontamination
def leak_similarity(words, item, weight):
    from collections import Counter
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    a, b = grams(words), grams(item)
    low = sum(weight.get(g, 1.0) * min(a[g], b[g]) for g in a.keys() | b.keys())
    high = sum(weight.get(g, 1.0) * max(a[g], b[g]) for g in a.keys() | b.keys())
    return low / high if high else 0.0


def test_leaks_against_brute_force(spark):
    docs = {r.doc_id: word_hashes([r.text])[0].tolist() for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    items = {r.item_id: word_hashes([r.text])[0].tolist() for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()}
    found = {}
    for w in items.values():
        for g in {tuple(w[i:i + 5]) for i in range(len(w) - 4)}:
            found[g] = found.get(g, 0) + 1
    weight = {g: 1 / n for g, n in found.items()}
    want = set()
    for d, w in docs.items():
        places = {tuple(w[i:i + 5]): i for i in range(len(w) - 4)}
        for i, item in items.items():
            if any(tuple(item[k:k + 5]) in places for k in range(len(item) - 4)):
                n = len(item)
                if max(leak_similarity(w[p:p + n], item, weight) for p in range(max(1, len(w) - n + 1))) >= 0.8:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op8_decontaminate(spark, SF_MID).collect()}
    assert len(want) > 10 and set(got) <= want and len(set(got) & want) >= 0.9 * len(want)
    exact = {(d, i) for d, i in want if any(docs[d][p:p + len(items[i])] == items[i] for p in range(len(docs[d])))}
    assert exact <= set(got)  # passages as they are: all of them


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(2)
    index = decontaminate.ItemIndex(list(range(30)), [prose(i, 20) for i in range(30)])
    size, _, items, _ = index.sizes[0]
    prints = []
    for r in range(0, 30):
        flips = rng.choice(64, r, replace=False)
        prints.append(items[r % len(items)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if r else items[0])
    prints = np.concatenate([np.array(prints, np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    w, i = index.candidates(prints, 0)
    want = {(a, b) for a in range(len(prints)) for b in range(len(items)) if int(prints[a] ^ items[b]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_passages_at_any_place_and_altered(spark):
    items = [(i, prose(5000 + i, 20 + 2 * i)) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for k in range(200):
        i, item = items[k % 20]
        words = item.split()
        if k % 4 == 1 and len(words) >= 50:
            words[-1] = "changed"  # still 0.8
        rows.append((k, prose(k, 3 * k) + " " + " ".join(words).upper() + "; " + prose(900 + k, k % 50)))
        want.add((k, i))
    rows.append((500, prose(777, 5000)))
    docs = docs_frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.dtypes == docs.dtypes and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def planted_items(opening, own, families=2, size=100):
    """Items of ``families`` openings, each common to ``size`` items."""
    return [(f * size + k, prose(7000 + f, opening) + " " + prose(8000 + f * size + k, own)) for f in range(families) for k in range(size)]


def test_items_with_common_openings_are_found():
    items = planted_items(18, 42)
    index = decontaminate.ItemIndex(*map(list, zip(*items)))
    weight = {}
    for _, t in items:
        w = word_hashes([t])[0].tolist()
        for g in {tuple(w[i:i + 5]) for i in range(len(w) - 4)}:
            weight[g] = weight.get(g, 0) + 1
    weight = {g: 1 / n for g, n in weight.items()}
    want = found = 0
    for i, t in items:  # the body behind the other family's opening
        other = items[(i + 100) % 200][1].split()[:18]
        text = " ".join([prose(9000 + i, 70), *other, *t.split()[18:], prose(9500 + i, 40)])
        w, item = word_hashes([text])[0].tolist(), word_hashes([t])[0].tolist()
        best = max(leak_similarity(w[p:p + 60], item, weight) for p in range(len(w) - 59))
        got = {x: score for _, x, _, _, score in index.search([text])}
        assert set(got) <= {i} and (i not in got or abs(got[i] - best) < 1e-9)
        want += best >= 0.8
        found += i in got
    assert want == 200 and found >= 0.9 * want


def test_own_half_of_an_item_is_found():
    items = planted_items(30, 30)
    index = decontaminate.ItemIndex(*map(list, zip(*items)))
    got = [{x for _, x, *_ in index.search([" ".join(t.split()[30:])])} for _, t in items]
    assert all(g <= {i} for g, (i, _) in zip(got, items)) and sum(len(g) for g in got) >= 0.9 * len(items)


def test_verification_counts_repeated_shingles():
    rng = random.Random(5)
    for _ in range(60):
        words = [["red", "blue", "green"][rng.randrange(3)] for _ in range(rng.randrange(5, 80))]
        item = [["red", "blue", "green"][rng.randrange(3)] for _ in range(rng.randrange(5, 40))]
        index = decontaminate.ItemIndex([1], [" ".join(item)])
        w, i = (word_hashes([" ".join(x)])[0] for x in (words, item))
        number, weight = index.look_up(decontaminate.shingles(w, 5))
        score, place = index.verify(number, weight, len(w), 0)
        n, w, i = len(i), w.tolist(), i.tolist()
        every = [leak_similarity(w[p:p + n], i, {}) for p in range(max(1, len(w) - n + 1))]
        assert abs(score - max(every)) < 1e-9 and abs(every[place] - score) < 1e-9


def test_neighbouring_texts_do_not_matter():
    items = [(i, prose(5000 + i, 30)) for i in range(8)]
    index = decontaminate.ItemIndex(*map(list, zip(*items)))
    half = items[3][1].split()
    apart = [" ".join(half[:14]), " ".join(half[14:]), prose(1, 3)]
    assert not list(index.search(apart))
    texts = [prose(4, 90) + " " + items[2][1], None, "", items[5][1] + " " + prose(6, 2)]
    alone = [(r, *x[1:]) for r, t in enumerate(texts) for x in index.search([t])]
    assert list(index.search(texts)) == alone and {x[1] for x in alone} == {2, 5}


def test_long_items_do_not_wrap():
    item = prose(1, 70_000)
    index = decontaminate.ItemIndex([1], [item])
    words = item.split()
    words[10::50] = ["other"] * len(words[10::50])
    assert [x[:2] for x in index.search([prose(2, 40_000) + " " + " ".join(words)])] == [(0, 1)]


def test_long_texts_are_searched_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    items = [(i, prose(5000 + i, 30)) for i in range(8)]
    text = " ".join(prose(i, 431) + " " + t for i, t in items)
    index = decontaminate.ItemIndex(*map(list, zip(*items)))
    assert {i for _, i, *_ in index.search([text, None, ""])} == set(range(8))


# ---------------------------------------------------------------- repeated passages
def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def report(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_repeats_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert report(repeats.op10_repeated_passages(spark, SF_SMALL)) == brute_repeats(rows)


def repeat_rows(n=120):
    rng = random.Random(6)
    passages = [prose(i, 25 + 10 * i) for i in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(100 + i, rng.randrange(5, 60))]
        if i % 2:
            parts += [passages[0][:rng.randrange(90, 140)], prose(300 + i, 3)]  # about 100 bytes, and different ends
        if i % 3 == 0:
            parts += [rng.choice(passages), rng.choice(passages)]
        if i % 10 == 0:
            parts.append("ab" * 150 + "é" * 80)  # within itself
        rows.append((i, " ".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "x" * 99), (n + 3, "x" * 100), (n + 4, "x" * 101), (n + 5, "y" * 3000), (n + 6, rows[5][1]), (n + 7, rows[5][1])]


@pytest.mark.parametrize("group, plain, block, chunk", [(512, 4, 1_500_000, 1_000_000), (8, 2, 3000, 2000)])
def test_repeats_against_brute_force(spark, monkeypatch, group, plain, block, chunk):
    """Also with tiny groups, blocks and chunks, so that salted groups, cut texts and block ends all occur."""
    for name, value in (("GROUP", group), ("PLAIN", plain), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(repeats, name, value)
    rows = repeat_rows()
    assert report(repeats.repeat_report(docs_frame(spark, rows).repartition(7))) == brute_repeats(rows)


def test_rows_that_share_an_id(spark):
    long = prose(3, 60)
    out = repeats.repeat_report(docs_frame(spark, [(1, long), (1, long), (None, long), (2, long + " more")])).collect()
    assert sorted(r.n_removed > 0 for r in out) == [False, True, True, True]
    assert [r.n_removed for r in out if r.doc_id is None] == [0]  # nulls come first


def test_interval_tree_gives_all_maximal_repeats():
    rng = random.Random(8)
    for trial in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 5))]
        least = rng.randrange(2, 5)
        want = set()
        subs = {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for j in range(i + least, len(x) + 1):
                    subs.setdefault(x[i:j], []).append((t, i))
        for s, at in subs.items():
            if len(at) < 2:
                continue
            before = {texts[t][i - 1] if i else (-1, t) for t, i in at}
            after = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (-1, t) for t, i in at}
            if len(before) > 1 and len(after) > 1:
                want.add((len(s), tuple(sorted(at))))
        got = {(n, tuple(at)) for n, at in repeats.maximal_repeats(texts, least)}
        assert got == want


def test_cut_repeats_keeps_columns(spark):
    docs = docs_frame(spark, repeat_rows())
    cut = repeats.cut_repeats(docs)
    assert cut.dtypes == docs.dtypes
    want = brute_repeats(repeat_rows())
    for r in cut.collect():
        if want[r.doc_id][1] == 0:
            assert r.text == docs_by_id()[r.doc_id]
        else:
            assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)


def docs_by_id():
    return dict(repeat_rows())


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    columns = spark.read.parquet(f"{SF_MID}/documents.parquet")
    docs, before = columns, None
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF_MID).cache()
        assert after.dtypes == columns.dtypes, name
        assert 0 < after.count() <= docs.count()
        before, docs = docs, after
    assert before is not None
    got = P.run(spark, SF_MID)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "repeated passages", "decontamination", "mixing"]


def test_pipeline_catches_planted_cases(spark, tmp_path):
    from tests.llm.helpers import write_tables
    items = [(i, prose(7000 + i, 30)) for i in range(3)]
    clean = [(i, prose(i, 120), f"s{i % 4}") for i in range(30)]
    near = [(100, clean[0][1] + " extra words", "s0"), (101, clean[1][1], "s1")]
    passage = prose(9000, 60)
    repeat = [(200 + i, prose(200 + i, 100) + "\n" + passage + "\n" + prose(260 + i, 50), "s2") for i in range(4)]
    leak = [(300, prose(300, 80) + " " + items[0][1] + " " + prose(301, 60), "s3")]
    bad = [(400, "too short", "s0"), (401, "again and again " * 60, "s1")]
    docs = docs_frame(spark, clean + near + repeat + leak + bad)
    sf = write_tables(tmp_path, documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    out = {r.doc_id: r.text for r in P.run(spark, sf).collect()}
    assert set(out) == {i for i, *_ in clean} | {200, 201, 202, 203}
    assert all(out[i] == t for i, t, _ in clean)
    assert sum(passage[5:150] in t for t in out.values()) == 1
