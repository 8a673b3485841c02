"""Near-duplicates by Order MinHash, verified by banded alignment.

k-mers are runs of five words, labelled with their occurrence number in the
text.  Each of ``SKETCHES`` hash functions picks the ``PICKS`` smallest labelled
k-mers and keeps them in text order; a sketch value is the hash of that ordered
pick, so it is sensitive to order and thus to edit similarity.  Texts that
share a value of one function are in one bucket.

In a bucket, members are first compared with one pivot: each text is aligned
with one of its pivots, which finds most classes with as many pairs as texts,
and then with those of its other pivots that are not known to be of its class.
Then every two other members that are not known to be of one class are
compared, linked ones included: a text that is like the pivot may also be like
texts that are not.  A bucket is never narrowed, so all texts that share a
value are verified or of one class.  Comparison is by block pairs of a bucket,
in tasks: lengths and bags of words (``BINS`` counts) give a lower bound of the
edit distance, and only pairs that it lets pass are aligned.  A pair belongs to
the first bucket that its texts share and is never a row: a bucket's tasks tell
only which texts have a partner, and in which groups of two times ``ALIGN`` texts
at most; a text goes once to each of its groups, where its pairs are made
again and aligned.  Classes that are joined on the way are not aligned again,
and only the links that join them are kept.
No bucket is collected or capped; a bucket of n texts of different classes
costs n * n / 2 comparisons of bags.

Similar are texts with ``1 - edit distance / longer length >= 0.8`` in words
(lower-cased runs of letters and digits).  A class is a connected component of
verified links.  Exact copies (equal texts) are one node from the start; their
rows are never compared.

Defined results: null and empty texts are equal to each other and to nothing
else; a text with fewer words than a k-mer is one k-mer; a text without words
is only like its exact copies; repeated rows are copies; the class id is the
smallest id of the class, null ids counting last; a class with null ids only
has a null id; an empty table gives an empty result; other columns are not read
(and kept as they are by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.alignment import within
from calibspark.llm.components import components
from calibspark.llm.scratch import materialise
from calibspark.llm.wordhash import BASE, mix, shingles, text_groups, word_hashes

KMER, SKETCHES, PICKS, SIMILARITY = 5, 64, 2, 0.8
#: Counts of a bag of words; texts of a block of a bucket; pairs compared together.
BINS, BLOCK, TOGETHER = 256, 8192, 1 << 14
#: Texts of a block of a bucket whose pairs are aligned in one group; words of pairs that are aligned together.
ALIGN, ALIGN_WORDS = 256, 1 << 19


def labelled_kmers(words: np.ndarray, per_text: np.ndarray, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, the same with its occurrence number, k-mers per text), in
    text order; a text with 1 to k - 1 words has one k-mer."""
    n = np.where(per_text >= k, per_text - k + 1, (per_text > 0).astype(np.int64))
    begin = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(n)), n)
    at = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    grams = shingles(np.concatenate([words, np.zeros(k, np.uint64)]), k)[at] if len(at) else np.zeros(0, np.uint64)
    for t in np.flatnonzero((per_text > 0) & (per_text < k)):
        own = words[begin[t]:begin[t] + per_text[t]]
        grams[np.cumsum(n)[t] - 1] = shingles(own, len(own))[0] + np.uint64(len(own))
    key = mix(grams + text.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return grams, mix(grams + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), n


def sketches(words: np.ndarray, per_text: np.ndarray, m: int = SKETCHES, picks: int = PICKS, k: int = KMER) -> np.ndarray:
    """Order MinHash values, one row for each text with words."""
    _, labelled, n = labelled_kmers(words, per_text, k)
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros((0, m), np.uint64)
    start = (np.cumsum(n) - n)[full]
    bits = np.uint64(max(1, int(len(labelled)).bit_length()))
    place = np.arange(len(labelled), dtype=np.uint64)
    out = np.empty((len(full), m), np.uint64)
    for i in range(m):
        h = mix(labelled ^ np.uint64(0xA0761D6478BD642F * (i + 1) & (1 << 64) - 1))
        h = (h >> bits << bits) | place  # the low bits tell where
        chosen = np.full((len(full), picks), len(labelled), np.int64)
        for p in range(picks):
            least = np.minimum.reduceat(h, start)
            has = n[full] > p
            chosen[has, p] = (least[has] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            h[chosen[has, p]] = ~np.uint64(0)
        chosen.sort(axis=1)
        value = np.full(len(full), i, np.uint64)
        for p in range(picks):
            there = chosen[:, p] < len(labelled)
            value = np.where(there, mix(value * np.uint64(BASE) + labelled[np.minimum(chosen[:, p], len(labelled) - 1)]), value)
        out[:, i] = value
    return out


def text_key(col: str = "text"):
    """128-bit digest of a text, the node of all its copies."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))


def bags(words: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each text's words counted in ``BINS`` bins by hash, counts up to 255."""
    text = np.repeat(np.arange(len(per_text)), per_text)
    bins = (words >> np.uint64(32)).astype(np.int64) % BINS
    return np.minimum(np.bincount(text * BINS + bins, minlength=len(per_text) * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def sketch_table(docs: DataFrame, m: int = SKETCHES) -> DataFrame:
    """(key, n_words, bag, sketch) of ``docs`` (key, text); texts without words are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                words, per_text = word_hashes(texts[lo:hi])
                rows = np.flatnonzero(per_text)
                values = sketches(words, per_text, m)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(pa.array(lo + rows)), pa.array(per_text[rows].astype(np.int64)),
                     pa.array([x.tobytes() for x in bags(words, per_text)[rows]], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m),
                                              pa.array(values.ravel().view(np.int64)))], ["key", "n_words", "bag", "sketch"])

    return docs.select("key", "text").mapInArrow(run, "key binary, n_words long, bag binary, sketch array<long>")


def bags_fit(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts with bags ``x`` and ``y`` of nx and ny words can be similar:
    each edit takes away one surplus word of either bag at most."""
    low = np.minimum(x, y).sum(axis=1, dtype=np.int32)
    surplus = np.maximum(x.sum(axis=1, dtype=np.int32) - low, y.sum(axis=1, dtype=np.int32) - low)
    longer = np.maximum(nx, ny)
    return surplus <= longer - np.ceil(similarity * longer - 1e-9)


def new_groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group; 0 for rows of a group of one block, 1 and 2 for those of two blocks)."""
    bucket, x, y, block = (t.column(c).to_numpy() for c in ("bucket", "x", "y", "block"))
    change = np.zeros(t.num_rows, bool)
    for c in (bucket, x, y):
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change), np.where(x == y, 0, np.where(block == x, 1, 2))


def earlier_values(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sketch values before the group's bucket, one row for each text, filled up with zeros; their number)."""
    lists = t.column("earlier").combine_chunks()
    number = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(number), int(number.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < number[:, None]] = lists.flatten().to_numpy()
    return out, number


def pairs_of_groups(group: np.ndarray, side: np.ndarray, label: np.ndarray, n: np.ndarray, bag: np.ndarray, earlier: np.ndarray,
                    similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, of different labels and without a common value
    ``earlier``, whose lengths and bags allow the similarity.  ``side`` is 0 for all rows of a
    group, or 1 and 2 for two blocks, whose pairs with one row of each are wanted.
    ``earlier`` has a row's sketch values before that of the group, as many in each
    row of a group, and zeros."""
    values, number = earlier
    order = np.lexsort((n, group))
    group, side, label, n, bag, values, number = (x[order] for x in (group, side, label, n, bag, values, number))
    place = group.astype(np.int64) << 40
    most = np.floor(n / similarity + 1e-6).astype(np.int64) if similarity > 0 else np.full(len(n), 1 << 39)
    end = np.searchsorted(place + n, place + most, side="right")
    partners = np.maximum(end - np.arange(len(n)) - 1, 0)
    upto = np.cumsum(partners)
    first = 0
    while first < len(n):  # rows with about TOGETHER pairs, one row at least
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOGETHER, side="right")))
        count = partners[first:last]
        a = np.repeat(np.arange(first, last), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        ok = (label[a] != label[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        for lo in range(0, len(a), TOGETHER):
            x, y = a[lo:lo + TOGETHER], b[lo:lo + TOGETHER]
            fit = bags_fit(bag[x], bag[y], n[x], n[y], similarity)
            x, y = x[fit], y[fit]
            own = ~((values[x] == values[y]) & (np.arange(values.shape[1]) < number[x][:, None])).any(axis=1)
            yield order[x[own]], order[y[own]]
        first = last


def partnered(rows: DataFrame, similarity: float) -> DataFrame:
    """(bucket, x, y, block, key, label, earlier) of ``rows`` (the same, n_words, bag), sorted
    by bucket, x and y within partitions: the texts that have a partner, with pairs x <= y
    of smaller blocks, of at most about ``ALIGN`` texts of like length, for each such pair once."""
    def handle(t: pa.Table) -> pa.RecordBatch:
        group, side = new_groups(t)
        n = t.column("n_words").to_numpy()
        bag = np.frombuffer(b"".join(t.column("bag").to_pylist()), np.uint8).reshape(-1, BINS)
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        # blocks of neighbours by length on each side of a group
        order = np.lexsort((n, side, group))
        part = group[order] * 3 + side[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        small = np.empty(t.num_rows, np.int64)
        small[order] = (np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))) // ALIGN
        wanted = np.zeros((t.num_rows, int(small.max()) + 1), bool)
        for a, b in pairs_of_groups(group, side, label, n, bag, earlier_values(t), similarity):
            wanted[a, small[b]] = True
            wanted[b, small[a]] = True
        row, other = np.nonzero(wanted)
        x, y, block = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "block"))
        own = (block << 32 | small)[row]
        other |= (x + y - block)[row] << 32
        at = pa.array(row)
        bucket, *same = (t.column(c).combine_chunks().take(at) for c in ("bucket", "key", "label", "earlier"))
        return pa.RecordBatch.from_arrays([bucket, *map(pa.array, (np.minimum(own, other), np.maximum(own, other), own)), *same],
                                          ["bucket", "x", "y", "block", "key", "label", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(handle, whole_groups(batches))

    return (rows.select("bucket", "x", "y", "block", "key", "label", "n_words", "bag", "earlier")
            .mapInArrow(run, "bucket long, x long, y long, block long, key binary, label binary, earlier array<long>"))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket, x and y, in tables that hold whole groups."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        ids = [held.column(c).to_numpy() for c in ("bucket", "x", "y")]
        before = np.flatnonzero((ids[0] != ids[0][-1]) | (ids[1] != ids[1][-1]) | (ids[2] != ids[2][-1]))
        if len(before):  # the last group may go on in the next batch
            yield held.slice(0, before[-1] + 1)
            held = held.slice(before[-1] + 1)
    if held is not None:
        yield held


def fitting_pairs(pairs: DataFrame, who: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those of ``pairs`` (h_a, h_b) whose bags allow the similarity; ``who`` is (h, key, n_words, bag)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bag_a", "bag_b"))
            ok = bags_fit(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), similarity)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    for c in ("a", "b"):
        of = who.select(F.col("h").alias(f"h_{c}"), F.col("key").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("bag").alias(f"bag_{c}"))
        pairs = pairs.hint("merge").join(of, f"h_{c}")
    return pairs.select("a", "b", "n_a", "n_b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


def verify(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b, text_a, text_b): those of enough similarity by alignment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            for lo, hi in text_groups(left, 1 << 21):
                both = []
                for texts in (left[lo:hi], right[lo:hi]):
                    words, per_text = word_hashes(texts)
                    both.append(np.split(words, np.cumsum(per_text)[:-1]))
                sizes = [max(len(x), len(y)) for x, y in zip(*both)]
                limits = [int(n - np.ceil(similarity * n - 1e-9)) for n in sizes]
                ok = within(list(zip(*both)), limits)
                rows = pa.array(lo + np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def joining_links(words: list[np.ndarray], a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray,
                  similarity: float = SIMILARITY) -> np.ndarray:
    """Numbers of pairs (a, b), of texts ``words``, that are similar and join
    classes (``label_a``, ``label_b``) not yet joined by the others.  A few pairs
    of each two classes are aligned first, then more; all of those that stay apart."""
    parent: dict = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def roots(x: np.ndarray) -> np.ndarray:
        values, at = np.unique(x, return_inverse=True)
        return np.array([root(v) for v in values.tolist()], np.int64)[at]

    size = np.array([len(w) for w in words], np.int64)
    todo, most, links = np.arange(len(a)), 1, []
    while len(todo):
        x, y = roots(label_a[todo]), roots(label_b[todo])
        apart = x != y
        todo, lo, hi = todo[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        order = np.lexsort((todo, hi, lo))
        todo, lo, hi = todo[order], lo[order], hi[order]
        new = np.ones(len(todo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        first = np.flatnonzero(new)
        nth = np.arange(len(todo)) - np.repeat(first, np.diff(np.append(first, len(todo))))
        now, todo = todo[nth < most], todo[nth >= most]
        part = np.cumsum(size[a[now]] + size[b[now]]) // ALIGN_WORDS
        for group in np.split(now, np.flatnonzero(np.diff(part)) + 1):
            longer = np.maximum(size[a[group]], size[b[group]])
            limits = (longer - np.ceil(similarity * longer - 1e-9)).astype(np.int64).tolist()
            ok = within([(words[i], words[j]) for i, j in zip(a[group].tolist(), b[group].tolist())], limits)
            for k in group[ok].tolist():
                x, y = root(int(label_a[k])), root(int(label_b[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append(k)
        most *= 4
    return np.array(sorted(links), np.int64)


def block_links(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join classes among the texts of each group of ``rows``
    (see ``partnered``).  A text goes once to each of its groups."""
    def handle(t: pa.Table) -> pa.RecordBatch:
        group, side = new_groups(t)
        texts, words, bag = t.column("text").to_pylist(), [], []
        for lo, hi in text_groups(texts):
            hashes, per_text = word_hashes(texts[lo:hi])
            words += [w.copy() for w in np.split(hashes, np.cumsum(per_text)[:-1])]
            bag.append(bags(hashes, per_text))
        n = np.array([len(w) for w in words], np.int64)
        key = t.column("key").combine_chunks()
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        found = list(pairs_of_groups(group, side, label, n, np.concatenate(bag), earlier_values(t), similarity))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        links = joining_links(words, a, b, label[a], label[b], similarity)
        return pa.RecordBatch.from_arrays([key.take(pa.array(a[links])), key.take(pa.array(b[links]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(handle, whole_groups(batches))

    rows = rows.hint("merge").join(texts, "key").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return rows.select("bucket", "x", "y", "block", "key", "label", "earlier", "text").mapInArrow(run, "a binary, b binary")


def near_duplicate_labels(docs: DataFrame, m: int = SKETCHES, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels) of ``docs`` (id, text, key): nodes (key, id) are the
    distinct texts with the smallest id of their copies, labels (node, label)
    the components of linked nodes."""
    nodes = materialise(docs.groupBy("key").agg(F.min("id").alias("id")), "nodes")
    sketch = materialise(sketch_table(docs, m).withColumn("h", F.xxhash64("key")), "sketches")
    # rows of two longs: the text's hash and the bucket; keys and bags come only to texts that share a bucket
    members = sketch.select("h", F.explode("sketch").alias("bucket"))
    # the smallest hash is the pivot: texts of one class meet the same pivot in most of their buckets
    pivots = members.groupBy("bucket").agg(F.min("h").alias("pivot"), F.max("h").alias("hi")).where("pivot <> hi").select("bucket", "pivot")
    met = members.hint("merge").join(materialise(pivots, "pivots"), "bucket").where("h <> pivot").distinct()
    met = materialise(met, "met")
    shared = met.select("h").union(met.select("pivot")).distinct()
    who = sketch.join(shared, "h").dropDuplicates(["key"])
    who = materialise(who, "who")
    texts = member_texts(who, docs, nodes)
    pairs = met.select(F.col("h").alias("h_a"), F.col("pivot").alias("h_b")).distinct()
    pairs = materialise(fitting_pairs(pairs, who, similarity), "pairs")
    # one pivot of each text first: most of its other pivots are then known to be of its class
    first = materialise(pairs.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    known = components(materialise(verify(with_texts(first, texts), similarity), "found"))
    rest = materialise(pairs_apart(pairs.join(first, ["a", "b"], "left_anti"), known), "other-pairs")
    known = merged_labels(known, materialise(verify(with_texts(rest, texts), similarity), "found"))
    more = materialise(partnered(open_rows(met, known, who), similarity), "partnered")
    if more.isEmpty():
        return nodes, known
    return nodes, merged_labels(known, materialise(block_links(more, texts, similarity), "found"))


def pairs_apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are not of one class by ``known`` (node, label)."""
    a, b = (known.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def open_rows(met: DataFrame, known: DataFrame, who: DataFrame) -> DataFrame:
    """(bucket, x, y, block, key, label, n_words, bag, earlier): the members, but the
    pivot, of the buckets that are not of one class by ``known``, sorted by bucket, x and
    y within partitions.  Of blocks of a bucket each two, x <= y, are a group.  ``earlier`` are
    the sketch values before the bucket: two texts that share one of them are compared
    there, or were, if one of them is its pivot."""
    own = known.select(F.col("node").alias("key"), F.col("label").alias("own"))
    who = materialise(who.join(own, "key", "left").withColumn("label", F.coalesce("own", "key")).drop("own"), "labelled")
    rows = met.select("bucket", "h").hint("merge").join(who.select("h", "label"), "h")
    mixed = (rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"))
             .where("lo <> hi").select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    rows = met.select("bucket", "h").hint("merge").join(materialise(mixed, "mixed"), "bucket")
    rows = rows.hint("merge").join(who, "h").withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    rows = rows.withColumn("earlier", F.slice("sketch", F.lit(1), F.array_position("sketch", F.col("bucket")).cast("int") - 1))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block",
                       "key", "label", "n_words", "bag", "earlier")
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def merged_labels(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, label) after more links: only links between different
    labels are looked at, and only nodes in links have a row."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    links = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = moved.select(F.col("label").alias("node"), F.col("to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return materialise(old.unionByName(fresh), "labels")


def member_texts(who: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, text) of the texts ``who`` (key), which share a bucket with another one."""
    none = F.lit(-(1 << 63))
    wanted = materialise(who.select("key").join(nodes, "key").select("key", F.coalesce("id", none).alias("id")), "wanted")
    # one row of each text: that with the node's id; a plain shuffle at every size
    rows = docs.select("key", F.coalesce("id", none).alias("id"), "text").hint("merge").join(wanted, ["key", "id"])
    return materialise(rows.select("key", "text"), "texts")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the texts of both."""
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")


def class_table(docs: DataFrame, m: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_key): each distinct text's class, by its smallest
    id and by the text that has it."""
    nodes, labels = near_duplicate_labels(docs, m, similarity)
    known = materialise(nodes.join(labels.withColumnRenamed("node", "key"), "key", "left")
                        .select("key", "id", F.coalesce("label", "key").alias("label")), "classes")
    first = F.min_by(F.struct("id", "key"), F.struct(F.col("id").isNull(), F.col("id"), F.col("key")))
    best = materialise(known.groupBy("label").agg(first.alias("c")).select("label", F.col("c.id").alias("class_id"),
                                                                           F.col("c.key").alias("class_key")), "best")
    return materialise(known.join(best, "label").select("key", "class_id", "class_key"), "class-of")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = SKETCHES,
                           similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", text_key())
    classes = class_table(rows, m, similarity)
    return rows.select("id", "key").join(classes, "key").select(F.col("id").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, m: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with all columns.
    Of rows that share that id and text one stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("key", text_key())
    classes = class_table(rows, m, similarity)
    stay = materialise(classes.where("key = class_key").select(F.col("key").alias("__key"), F.coalesce("class_id", F.lit(-(1 << 63))).alias("__id")),
                       "stay")
    kept = docs.withColumns({"__key": text_key(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))})
    kept = kept.join(stay, ["__key", "__id"], "left_semi")
    return kept.dropDuplicates(["__key", "__id"]).select(*docs.columns)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
