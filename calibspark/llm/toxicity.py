"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model gets the words
of the text and the probabilities of the categories before it.  In training
those probabilities are out-of-fold predictions, so that a later model learns
from errors like the ones it will meet.

Training uses a bounded sample of the labelled rows (``SAMPLE``, smallest hash
of the id first; equal texts count once), as sets of distinct words, in one
task.  Scoring covers every whole text.

Defined results: a null or empty text has no words and gets the models'
intercepts; labelled rows with a null label, an unknown id or a null text are
not trained on; a category without both classes in the sample gets a constant;
an id that is labelled twice is trained on once with its larger labels;
repeated rows score alike; an empty table gives an empty result; columns other
than id, text and labels are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows to train on at most, the folds, and the documents that must hold a word to be a feature.
SAMPLE, FOLDS, MIN_DOCS = 6_000, 4, 3
#: Least deviation of a feature, L2 penalty on the scaled weights, and gradient steps.
MIN_Z, REG, STEPS = 4.0, 0.1, 150
WORD = re.compile(r"\w+")

#: Categories in chain order, from the columns of ``labels``: badly formed text,
#: toxic text, and toxic text that is otherwise well formed.
CATEGORIES = {
    "low_quality": "1 - quality",
    "toxic": "toxic",
    "toxic_prose": "toxic * quality",
}


def features(text: str | None) -> set[str]:
    """The distinct words of a text and their beginnings of 4 and 5 characters, which inflected forms share."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for n in (4, 5) for w in words if len(w) >= n}


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of word indices (each at most once a row) with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], n_words: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.n, self.n_words = len(rows), n_words

    def subset(self, keep: np.ndarray) -> "Sparse":
        out, of = Sparse([], self.n_words), np.flatnonzero(keep)
        place = np.full(self.n, -1)
        place[of] = np.arange(len(of))
        hit = keep[self.row]
        out.row, out.col, out.n = place[self.row[hit]], self.col[hit], len(of)
        return out

    def columns(self, keep: np.ndarray) -> "Sparse":
        out = Sparse([], self.n_words)
        out.row, out.col, out.n = self.row[keep], self.col[keep], self.n
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.n_words)


def log_ratio(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of a word's document frequency in the two classes."""
    pos, neg = x.tdot(y) + 0.5, x.tdot(1 - y) + 0.5
    return np.log(pos / (y.sum() + 1)) - np.log(neg / ((1 - y).sum() + 1))


def telling(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Words whose documents' classes differ from the mean by MIN_Z standard errors."""
    found, share = x.tdot(np.ones(len(y))), y.mean()
    return np.abs(x.tdot(y) - found * share) >= MIN_Z * np.sqrt(np.maximum(found, 1) * share * (1 - share))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, reg: float = REG, steps: int = STEPS):
    """(word weights, dense weights, intercept) of an L2-regularised logistic
    regression on words scaled by their log ratio; accelerated gradient steps."""
    if not 0 < y.sum() < len(y):
        return np.zeros(x.n_words), np.zeros(dense.shape[1]), 6.0 if len(y) and y.all() else -6.0
    scale = np.where(telling(x, y), log_ratio(x, y), 0)
    scale = scale / max(np.abs(scale).max(initial=0), 1e-9)
    used = scale[x.col] != 0
    x = x.columns(used)
    v = np.ones(x.n_words + dense.shape[1] + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        u = x.dot(v[:x.n_words] * scale) + dense @ v[x.n_words:-1] + v[-1]
        v = np.concatenate([x.tdot(u) * scale, dense.T @ u, [u.sum()]])
    step = 1 / (0.25 * 1.1 * np.linalg.norm(v) + reg)
    w = np.zeros(x.n_words + dense.shape[1] + 1)
    prev, momentum, loss_before = w.copy(), 1.0, np.inf

    def margin(v):
        return x.dot(v[:x.n_words] * scale) + dense @ v[x.n_words:-1] + v[-1]

    for _ in range(steps):
        after = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        ahead = w + (momentum - 1) / after * (w - prev)
        z = margin(ahead)
        err = sigmoid(z) - y
        grad = np.concatenate([x.tdot(err) * scale + reg * ahead[:x.n_words],
                               dense.T @ err + reg * ahead[x.n_words:-1], [err.sum()]])
        prev, w = w, ahead - step * grad
        loss = np.logaddexp(0, -np.where(y > 0, z, -z)).sum() + reg / 2 * (ahead[:-1] ** 2).sum()
        momentum = 1.0 if loss > loss_before else after  # start the momentum anew where the loss rose
        loss_before = loss
    return w[:x.n_words] * scale, w[x.n_words:-1], w[-1]


def fit_chain(words: list[list[str]], labels: np.ndarray, fold: np.ndarray, min_docs: int = MIN_DOCS) -> pd.DataFrame:
    """Model rows (category, feature, weight) of a chain over the columns of
    ``labels``.  A feature is ``w:`` and a word, ``p:`` and the number of an
    earlier category, or ``bias``."""
    vocabulary = sorted(w for w, n in Counter(w for r in words for w in r).items() if n >= min_docs)
    index = {w: i for i, w in enumerate(vocabulary)}
    x = Sparse([np.array([index[w] for w in r if w in index], np.int64) for r in words], len(vocabulary))
    earlier, out = np.zeros((len(words), 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        oof = np.zeros(len(y))
        for f in np.unique(fold):
            inside = fold == f
            ww, dw, b = fit_logistic(x.subset(~inside), earlier[~inside], y[~inside])
            oof[inside] = sigmoid(x.subset(inside).dot(ww) + earlier[inside] @ dw + b)
        ww, dw, b = fit_logistic(x, earlier, y)
        out += [(c, f"w:{w}", float(v)) for w, v in zip(vocabulary, ww) if v]
        out += [(c, f"p:{i}", float(v)) for i, v in enumerate(dw)] + [(c, "bias", float(b))]
        earlier = np.column_stack([earlier, oof])
    return pd.DataFrame(out, columns=["category", "feature", "weight"])


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> DataFrame:
    """The bounded labelled sample: (doc_id, y array, words array)."""
    y = F.array(*[F.expr(e).cast("double") for e in categories.values()])
    known = labels.select("doc_id", y.alias("y")).where("doc_id IS NOT NULL AND NOT exists(y, v -> v IS NULL)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    known = known.orderBy(order, "doc_id").limit(sample)  # the documented bound of the training sample
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy(F.sha2("text", 256).alias("k")).agg(F.min_by(F.struct("doc_id", "y", "text"), "doc_id").alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "words": [sorted(features(t)) for t in b["text"]]})

    return texts.select("r.*").mapInPandas(run, "doc_id long, y array<double>, words array<string>")


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE,
                folds: int = FOLDS) -> list[tuple[int, str, float]]:
    """Model rows; their number is bounded by the sample."""
    n_categories = len(categories)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        fold = (pdf["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % folds
        y = np.array(pdf["y"].tolist(), float).reshape(-1, n_categories)
        return fit_chain([list(w) for w in pdf["words"]], y, fold)

    rows = training_rows(docs, labels, categories, sample)
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "category int, feature string, weight double")
    return [tuple(r) for r in model.collect()]


def score_chain(docs: DataFrame, model: list[tuple[int, str, float]], categories: dict[str, str] = CATEGORIES,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ...) per row of ``docs``."""
    names = list(categories)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(names)
        words = sorted({f[2:] for _, f, _ in shared.value if f.startswith("w:")})
        index = {w: i for i, w in enumerate(words)}
        weight, chain, bias = np.zeros((len(words), k)), np.zeros((k, k)), np.full(k, -6.0)
        for c, f, v in shared.value:
            if f.startswith("w:"):
                weight[index[f[2:]], c] = v
            elif f.startswith("p:"):
                chain[int(f[2:]), c] = v
            else:
                bias[c] = v
        known = index.keys()
        for b in batches:
            z = np.tile(bias, (len(b), 1))
            for i, t in enumerate(b["text"]):
                if found := known & features(t):
                    z[i] += weight[sorted(index[w] for w in found)].sum(0)
            p = np.zeros_like(z)
            for c in range(k):
                p[:, c] = sigmoid(z[:, c] + p[:, :c] @ chain[:c, c])
            yield pd.DataFrame({"doc_id": b["doc_id"], **{f"p_{n}": p[:, c] for c, n in enumerate(names)}})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"p_{n} double" for n in names))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_chain(docs, model)
    return scored.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES],
                         (F.col("p_toxic") >= 0.5).alias("toxic"))
