"""Text to vectors: tokens padded to a fixed length, and a pluggable batch embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LENGTH, SIZE = 512, 768


def token_ids(col, max_length: int = MAX_LENGTH, vocabulary: int = 1 << 20, pad: int = 0):
    """Hashed ids (from 1) of the words and marks of a text, cut and padded to a fixed length."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1), lambda w: w != "")
    ids = F.transform(F.slice(words, 1, max_length), lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(vocabulary - 1)) + 1).cast("int"))
    return F.concat(ids, F.array_repeat(F.lit(pad), F.lit(max_length) - F.size(ids)))


def hashing_embedder(size: int = SIZE) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed hashed word counts; stands where no trained encoder is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1.0 if h & 0x80000000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder, out: str = "embedding") -> DataFrame:
    """Adds the vector of a text.  ``make`` builds the embedder once per Python worker; it gets batches of texts."""
    made: list = []

    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(make())
        return pd.Series(list(np.asarray(made[0](texts.fillna("").tolist()), np.float64)))

    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text))
