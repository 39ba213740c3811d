"""Embedding of code: an interface, and a default that needs no weights.

The default hashes tokens into a vector of signed counts and scales it to unit length; it stands in for a neural encoder,
whose weights aren't available offline, and makes no claim to agree with one.
"""

from __future__ import annotations

from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
import re
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.functions.text import TOKEN


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for token in re.findall(TOKEN, t or ""):
                h = crc32(token.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def embed(code: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.encode(texts.tolist())))

    return run(code)
