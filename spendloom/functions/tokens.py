"""Counters of tokens for operators that take one: a quarter of the characters, or a vocabulary's exact count."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokens = Callable[[str], int]


def quarter(text: str) -> int:
    """A token for each four characters begun."""
    return -(-len(text) // 4)


def third(text: str) -> int:
    """The estimate for code: a token for each three characters begun."""
    return -(-len(text) // 3)


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Exact:
    """Counts by a byte-pair vocabulary, a file of base64 tokens and ranks that all workers have; read once in each."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __call__(self, text: str) -> int:
        return len(_encoding(self.path, self.pattern).encode_ordinary(text))


def counted(text: Column, tokens: Tokens) -> Column:
    """A column of counts, batch by batch; null for null. The estimates need none: F.ceil(F.length(text) / 4) stays in the JVM."""
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokens(t)).astype("Int64")

    return count(text)
