"""Text functions that need a loop: canonical JSON and hashed trigram vectors, batch by batch."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of nesting that canonical JSON goes down.
DEPTH = 100
#: Fixed values of the embedder: gram length, components, and FNV-1a's offset and prime.
GRAM, SIZE, OFFSET, PRIME = 3, 256, 0x811C9DC5, 0x01000193


def number(x: float) -> str:
    """A number in the shortest form that reads back as the same double: no exponent from 1e-6 up to 1e21, -0 as 0."""
    if x == 0:
        return "0"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    exponent = int(power or 0) + len(whole) - (len(whole + part) - len(digits))  # of the point before the first digit
    digits = digits.rstrip("0")
    if 0 < exponent <= 21:
        out = digits[:exponent].ljust(exponent, "0") + ("." + digits[exponent:] if len(digits) > exponent else "")
    elif -6 < exponent <= 0:
        out = "0." + "0" * -exponent + digits
    else:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if exponent > 0 else '-'}{abs(exponent - 1)}"
    return "-" * (x < 0) + out


class Refused(ValueError):
    """Not a value that has a canonical form."""


def _refuse(x: str) -> None:
    raise Refused(x)


def _encoded(x: Any, depth: int) -> str:
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, float):
        if not math.isfinite(x):
            raise Refused("not finite")
        return number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if depth <= 0:
        raise Refused("too deep")
    if isinstance(x, list):
        return "[" + ",".join(_encoded(y, depth - 1) for y in x) + "]"
    keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_encoded(x[k], depth - 1)}" for k in keys) + "}"


def canonical(text: str | None, depth: int = DEPTH) -> str | None:
    """The canonical form of a JSON text: keys in order of UTF-16 units, the last of equal keys, numbers as doubles in their shortest form, no spaces.

    None for what isn't JSON, holds a number beyond doubles, or nests deeper.
    """
    if text is None:
        return None
    try:
        return _encoded(json.loads(text, parse_int=float, parse_constant=_refuse), depth)
    except (ValueError, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """canonical for a column."""
    return texts.map(canonical, na_action="ignore").astype(object)


def json_digest(text: Column) -> Column:
    """sha256 of the canonical form: equal values have equal digests whatever the order of their keys. Null where there is none."""
    return F.sha2(canonical_json(text), 256)


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)


def embedding(text: str | None, gram: int = GRAM, size: int = SIZE, damped: bool = True) -> np.ndarray:
    """Signed counts of hashed grams of a text in lower case with single spaces, damped by a logarithm, of length one; zeros for an empty text."""
    out = np.zeros(size)
    lower = (text or "").lower()
    parts = [p for p in lower.translate({9: " ", 10: " ", 13: " "}).split(" ") if p]
    units = _units(" ".join(parts))
    if not len(units):
        return out
    n = max(1, len(units) - gram + 1)
    grams = np.stack([units[i : i + n] for i in range(min(gram, len(units)))], axis=1)
    distinct, counts = np.unique(grams, axis=0, return_counts=True)
    h = np.full(len(distinct), OFFSET, np.int64)
    for c in range(distinct.shape[1]):
        h = (h ^ (distinct[:, c] & 0xFF)) * PRIME & 0xFFFFFFFF
    # Grams of one count in one component are netted in whole numbers first: what cancels is zero, without a residue of the order of adding.
    kinds, kind = np.unique(counts, return_inverse=True)
    net = np.zeros((len(kinds), size))
    np.add.at(net, (kind.ravel(), h % size), np.where(h >> 16 & 1, -1, 1))
    for k, n in zip(kinds, net):
        out += n * (1 + np.log(k) if damped else float(k))
    length = math.sqrt((out**2).sum())
    return out / length if length else out


class Trigrams:
    """The embedder that operators take by default: a name for what made a vector, and vectors for texts."""

    def __init__(self, gram: int = GRAM, size: int = SIZE, damped: bool = True):
        self.gram, self.size, self.damped = gram, size, damped
        self.name = f"char-grams-{gram}-{size}-{int(damped)}"

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return np.stack([embedding(t, self.gram, self.size, self.damped) for t in texts])


def embedded(df: DataFrame, text: str, embed: Trigrams | None = None, name: str = "embedding") -> DataFrame:
    """df with an array of floats for each text by any object that makes an array (text, component) of a list of texts. A null text counts as empty; a column of that name is replaced."""
    embed = embed or Trigrams()
    base = df.drop(name)
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                vectors = np.asarray(embed(some.column(at).to_pylist()), np.float32)
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
                yield pa.record_batch([*some.columns, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[*some.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))
