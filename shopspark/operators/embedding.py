"""Texts to vectors, in Arrow batches, with a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.storage import spread

# Texts per model call and vector width.
BATCH_SIZE = 256
WIDTH = 384


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Default encoder: counts of hashed words, scaled to unit length.

    Needs no model file. A word's cell is its MD5 taken modulo the width, so
    vectors are the same on every machine.
    """

    def __init__(self, width: int = WIDTH, remembered: int = 1 << 18):
        self.width = width
        self.word = re.compile("[A-Za-z0-9]+")
        # Most words come again, so their cells are looked up, not hashed.
        self.known = lru_cache(remembered)(self.cell)

    def cell(self, word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            cells = [self.known(w.lower()) for w in self.word.findall(text)]
            row += np.bincount(np.array(cells, dtype=np.int64), minlength=self.width)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def embed(
    df: DataFrame,
    text: str,
    output: str = "embedding",
    make_encoder: Callable[[], Encoder] = HashedWords,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add the vector of the whole text; a null text gives a null vector.

    ``make_encoder`` runs once per task, so a model is loaded once and then fed
    ``batch_size`` texts at a time.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            given = texts[texts.notna()]
            for start in range(0, len(given), batch_size):
                part = given.iloc[start : start + batch_size]
                block = np.asarray(encoder(part.tolist()), dtype=np.float32)
                for position, vector in zip(part.index, block):
                    vectors.at[position] = vector
            yield vectors

    # Marked so that a later filter on the vector does not run the model again.
    return spread(df).withColumn(output, encode.asNondeterministic()(F.col(text)))


def embed_query(text: str, make_encoder: Callable[[], Encoder] = HashedWords) -> list[float]:
    """The vector of one query text, as stored vectors are made."""
    return [float(x) for x in np.asarray(make_encoder()([text]), dtype=np.float32)[0]]
