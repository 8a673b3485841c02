"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its runs without white space, each with the word mark
in front.  The distinct pre-tokens of a batch form a trie; a node's unigram
forward score (the best log-probability of any split of the prefix into
pieces) depends on the prefix alone, so it is computed once for all pre-tokens
below the node, and each terminal stores its token count.

The trie is walked in sorted order: neighbours share the path of their common
prefix, whose scores stay on the stack, and only the rest is computed.

The vocabulary file holds ranks, not probabilities: a piece of rank r gets the
Zipf log-probability ``-ln((r + 1) * H)``.  A character without a piece falls
back to its UTF-8 bytes.  Ties between splits go to the one with fewer tokens.

Memory: one batch of texts, its distinct pre-tokens, and a store of at most
``STORE`` finished pre-tokens, which is emptied when full (a lookup saved, not
a limit: a pre-token that isn't there is computed again).  No shuffle.

Defined results: a null or empty text has no pre-tokens and no tokens; very
long pre-tokens are split like any other; repeated rows count alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
STORE = 400_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a vocabulary file, by rank."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def piece_scores(pieces: list[str]) -> dict[str, float]:
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - norm for r, p in reversed(list(enumerate(pieces)))}


class TrieCounter:
    """Token counts of pre-tokens under unigram scores."""

    def __init__(self, scores: dict[str, float]):
        # pieces by their characters from the last to the first; "" holds a piece's score
        self.ends: dict = {}
        for piece, score in scores.items():
            node = self.ends
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = score
        self.byte_score = min(scores.values(), default=0.0) - 1.0

    def counts(self, pretokens: Iterable[str]) -> dict[str, int]:
        """Token count of each distinct pre-token."""
        out: dict[str, int] = {}
        best, n_tokens, path = [0.0], [0], ""
        for word in sorted(pretokens):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], n_tokens[shared + 1:]
            for i in range(shared, len(word)):
                self._node(word, i + 1, best, n_tokens)
            out[word] = n_tokens[len(word)]
            path = word
        return out

    def _node(self, word: str, end: int, best: list[float], n_tokens: list[int]) -> None:
        """Forward score of the prefix ``word[:end]`` from its own prefixes'."""
        top, count, node, at = -math.inf, 0, self.ends, end
        while at:
            node = node.get(word[at - 1])
            if node is None:
                break
            at -= 1
            if "" in node:
                score = best[at] + node[""]
                if score > top or (score == top and n_tokens[at] + 1 < count):
                    top, count = score, n_tokens[at] + 1
        if word[end - 1] not in self.ends or "" not in self.ends[word[end - 1]]:
            n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score = best[end - 1] + n_bytes * self.byte_score
            if score > top:
                top, count = score, n_tokens[end - 1] + n_bytes
        best.append(top)
        n_tokens.append(count)


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``docs``.  ``pieces`` is the
    vocabulary, a fixed list that is sent to the executors once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, store = TrieCounter(piece_scores(shared.value)), {}
        for batch in batches:
            split = [[] if t is None else t.split() for t in batch["text"]]
            if len(store) > STORE:
                store.clear()
            new = set().union(*split).difference(store)
            marked = counter.counts(MARK + w for w in new)
            store.update((w, marked[MARK + w]) for w in new)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(w) for w in split],
                                "n_tokens": [sum(map(store.__getitem__, w)) for w in split]})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces())
