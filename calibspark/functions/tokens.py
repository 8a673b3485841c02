"""Tokens and token-id arrays.

The default tokenizer is whitespace-attached words: every token is a run of
white space followed by a run of non-white-space (``\\s*\\S+``).  It runs in
the JVM (``regexp_extract_all``), decodes losslessly by concatenation (up to
trailing white space) and, because separators are white space, the tokens of
a concatenation are the concatenation of the tokens -- the property the
stream recipes rely on.  Model tokenizers plug in through ``encoder_udf``.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_TOKEN = r"\s*\S+"
WORD = r"\S+"


def tokenize(text: Column) -> Column:
    """``array<string>`` of whitespace-attached word tokens."""
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), 0)


def token_count(text: Column) -> Column:
    """F5 without building the token strings' prefixes: number of word runs."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), 0))


def decode(tokens: Column) -> Column:
    """tokens back to text."""
    return F.array_join(tokens, "")


def head_tokens(tokens: Column, n: int | Column) -> Column:
    """The first ``n`` tokens."""
    return F.slice(tokens, 1, n if isinstance(n, Column) else F.lit(n))


def window_tokens(tokens: Column, start0: Column, n: int) -> Column:
    """tokens ``[start0, start0 + n)`` (0-based start)."""
    return F.slice(tokens, start0 + 1, F.lit(n))


def truncate_ids(ids: Column, max_length: int) -> Column:
    """keep at most ``max_length - 1`` ids."""
    return F.slice(ids, 1, F.lit(max_length - 1))


def left_pad(ids: Column, pad_id: int, width: Column) -> Column:
    """left-pad to ``width`` with ``pad_id``."""
    return F.concat(F.array_repeat(F.lit(pad_id), F.greatest(width - F.size(ids), F.lit(0))), ids)


def drop_leading(ids: Column, skip: list[int]) -> Column:
    """drop leading ids in ``skip`` (pad / BOS); all skipped -> empty."""
    first = F.array_position(F.transform(ids, lambda x: ~x.isin(*skip)), F.lit(True))
    return F.when(first == 0, F.array().cast("array<int>")).otherwise(
        F.slice(ids, first, F.size(ids)))


def before_first_special(ids: Column, specials: list[int]) -> Column:
    """ids before the first special id (all when there is none)."""
    hit = F.array_position(F.transform(ids, lambda x: x.isin(*specials)), F.lit(True))
    return F.when(hit == 0, ids).otherwise(F.slice(ids, 1, hit - 1))


def trim_generated(ids: Column, pad_id: int, bos_id: int, specials: list[int]) -> Column:
    """Generated ids -> content ids: leading pad/BOS removed, then cut at the
    first remaining special id."""
    return before_first_special(drop_leading(ids, [pad_id, bos_id]), specials)


def encoder_udf(make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]],
                add_bos: int | None = None):
    """A vectorised (Arrow) UDF ``text -> array<int>`` from a factory of a
    batch encoder.  The encoder is built once per Python worker."""
    cache: dict = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        enc = cache.get("enc")
        if enc is None:
            enc = cache["enc"] = make_encoder()
        out = enc(texts.fillna("").tolist())
        if add_bos is not None:
            out = [[add_bos] + list(x) for x in out]
        return pd.Series(out)

    return encode


def decoder_udf(make_decoder: Callable[[], Callable[[list[list[int]]], list[str]]]):
    """A vectorised UDF ``array<int> -> string``."""
    cache: dict = {}

    @F.pandas_udf("string")
    def dec(ids: pd.Series) -> pd.Series:
        d = cache.get("dec")
        if d is None:
            d = cache["dec"] = make_decoder()
        return pd.Series(d([list(x) for x in ids]))

    return dec


class Tokenizer:
    """Column-level tokenizer used by the sampling recipes.

    ``encode``: text -> array column; ``decode``: array -> text;
    ``count``: text -> token count (defaults to ``size(encode(text))``).
    """

    def __init__(self, encode, decode, count=None, name: str = "custom"):
        self.encode = encode
        self.decode = decode
        self.count = count or (lambda text: F.size(encode(text)))
        self.name = name


WORDS = Tokenizer(tokenize, decode, token_count, name="words")


def udf_tokenizer(make_encoder, make_decoder, add_bos: int | None = None) -> Tokenizer:
    """A model tokenizer behind Arrow UDFs (one instance per Python
    worker).  ``add_bos`` prepends the BOS id as the reference's tokenizer
    calls do, so length gates and windows count it."""
    enc = encoder_udf(make_encoder, add_bos)
    dec = decoder_udf(make_decoder)
    return Tokenizer(lambda text: enc(text), lambda ids: dec(ids), name="udf")
