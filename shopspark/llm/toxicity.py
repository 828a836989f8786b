"""Toxicity by a linear classifier over character n-grams with naive Bayes scaling.

A text's features are its distinct character n-grams (3 to 5 characters of the
lower-cased text, hashed). On labelled text each n-gram gets its naive Bayes
log-count ratio, the log of the share of toxic texts that have it over the share
of other texts. The n-grams that tell the classes apart best are kept, their
presence is scaled by the ratio, and a logistic regression is fitted on top.

Fitting takes at most ``MAX_TRAIN`` labelled rows, chosen by a hash of their
identifier: counts are summed in Spark by n-gram, only the chosen n-grams' places
in these rows come to the driver (``MAX_TRAIN`` rows of ``FEATURES`` small numbers
at most), and the model is a table of fixed size that travels with the scoring
task. Scoring reads whole texts, a bounded slice at a time.

Defined cases: null text is empty; an empty text has no features and gets the
intercept's score. Labels that are null or whose identifier is null are left out
of training; a null identifier is not held out. Repeated rows score alike; of rows
of one labelled identifier the least text is learnt from, once. Without labelled
rows of both classes every score is 0. An empty table gives an empty result. Other
columns are kept by :func:`keep_clean` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.llm.resampling import bounded_sample
from shopspark.storage import materialize

SIZES = (3, 4, 5)
BITS = 20
FEATURES = 1024
MAX_TRAIN = 20_000
SMOOTHING = 0.5
LEAST_DOCS = 3
PENALTY = 1e-3
STEPS = 400
RATE = 0.02
LIMIT = 0.7
SLICE_CHARS = 1 << 20
HELD_OUT = 1
FOLDS = 3


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS


def slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram slot) of all n-grams, a slice of about ``SLICE_CHARS`` at a time.

    A text longer than a slice is cut with an overlap; its n-grams may then come
    twice, as any n-gram may.
    """
    gap = "\0" * max(SIZES)
    held: list[tuple[int, str]] = []
    room = SLICE_CHARS
    for number, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(len(text), 1), SLICE_CHARS):
            part = text[at : at + SLICE_CHARS + max(SIZES) - 1]
            held.append((number, part))
            room -= len(part)
            if room <= 0:
                yield _slots(held, gap)
                held, room = [], SLICE_CHARS
    if held:
        yield _slots(held, gap)


def _slots(held: list[tuple[int, str]], gap: str) -> tuple[np.ndarray, np.ndarray]:
    """Every text begins with a blank and ends with a gap; no n-gram starts in a gap or reaches past it."""
    joined = "".join(f" {t}{gap}" for _, t in held)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for _, t in held])
    inside = np.repeat(np.tile([True, False], len(held)), np.stack([sizes, np.full(len(held), len(gap))], 1).ravel())
    inside = inside[: len(codes) - max(SIZES) + 1]
    numbers = np.repeat(np.array([n for n, _ in held], np.int64), sizes)
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
    total = np.zeros(len(codes), np.uint32)
    out = []
    for size in range(1, max(SIZES) + 1):
        n = len(codes) - size + 1
        total = total[:n] + codes[size - 1 :] * np.uint32(factors[size - 1])
        if size in SIZES:
            h = total[: len(inside)][inside]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
            out.append(h >> np.uint32(32 - BITS))
    return np.tile(numbers, len(SIZES)), np.concatenate(out)


@dataclass
class Model:
    """Chosen slots, their ratios times weights, and the intercept."""

    places: np.ndarray  # 0 for slots that are not features, else 1 + the feature's number
    weights: np.ndarray
    intercept: float

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature) pairs."""
        found = [np.empty(0, np.int64)]
        for numbers, slot in slots(texts):
            feature = self.places[slot]
            at = np.flatnonzero(feature)
            found.append(np.unique(numbers[at] * (FEATURES + 1) + feature[at] - 1))
        pairs = np.unique(np.concatenate(found))
        return pairs // (FEATURES + 1), pairs % (FEATURES + 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        number, feature = self.features(texts)
        total = np.bincount(number, self.weights[feature], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _count(batches) -> Iterator[pd.DataFrame]:
    """Labelled texts by class that have each n-gram."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for rows in batches:
        for at in range(0, len(rows), 256):
            part = rows.iloc[at : at + 256]
            toxic = part["toxic"].to_numpy(np.int64)
            seen = [np.unique((n << BITS) | s.astype(np.int64)) for n, s in slots(part["text"].tolist())]
            pairs = np.unique(np.concatenate(seen))
            for kind in (0, 1):
                own = pairs[toxic[pairs >> BITS] == kind]
                counts[kind] += np.bincount(own & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    used = np.flatnonzero(counts.sum(0))
    yield pd.DataFrame({"slot": used, "clean": counts[0][used], "toxic": counts[1][used]})


def _gain(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Likelihood-ratio statistic of presence against class."""
    n = n_toxic + n_clean
    have, lack = toxic + clean, F.lit(n) - toxic - clean
    cells = [(toxic, have, n_toxic), (clean, have, n_clean), (n_toxic - toxic, lack, n_toxic), (n_clean - clean, lack, n_clean)]
    terms = [F.when(seen > 0, seen * F.log(seen * float(n) / (side * float(total)))).otherwise(0.0) for seen, side, total in cells]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def _fit_weights(number: np.ndarray, feature: np.ndarray, values: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps scaled per weight; both classes weigh alike."""
    n, x = len(toxic), values[feature]
    balance = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    at = np.append(np.full(len(values), 0.1), -1.0)  # the last is the intercept
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        total = np.bincount(number, x * at[feature], minlength=n) + at[-1]
        error = (1 / (1 + np.exp(-np.clip(total, -60, 60))) - toxic) * balance
        slope = np.append(np.bincount(feature, x * error[number], minlength=len(values)) + PENALTY * at[:-1], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        pace = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        at = at - pace * first / (np.sqrt(second) + 1e-10)
    return at[:-1], float(at[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on labelled documents outside the held-out fold; None without both classes."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("toxic"))
    known = materialize(bounded_sample(known, "id", max_train), "toxicity-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ``max_train`` rows bound the broadcast side; an identifier is learnt from once, by its least text.
    rows = rows.join(F.broadcast(known), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "toxic"), "toxicity-train")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        return None
    counts = rows.mapInPandas(_count, "slot long, clean long, toxic long").groupBy("slot")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + SMOOTHING) / (n[1] + 2 * SMOOTHING)) - F.log((F.col("clean") + SMOOTHING) / (n[0] + 2 * SMOOTHING))
    chosen = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
    chosen = chosen.select("slot", ratio.alias("ratio"), _gain(F.col("toxic"), F.col("clean"), n[1], n[0]).alias("gain"))
    chosen = chosen.orderBy(F.desc("gain"), "slot").limit(FEATURES).collect()
    places = np.zeros(1 << BITS, np.int32)
    places[[r.slot for r in chosen]] = np.arange(1, len(chosen) + 1)
    values = np.zeros(FEATURES)
    values[: len(chosen)] = [r.ratio for r in chosen]
    model = Model(places, values, 0.0)

    def read(batches):
        for part in batches:
            number, feature = model.features(part["text"].tolist())
            cuts = np.searchsorted(number, np.arange(len(part) + 1))
            packed = [feature[a:b].astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame({"features": packed, "toxic": part["toxic"]})

    train = rows.mapInPandas(read, "features binary, toxic int").collect()
    lists = [np.frombuffer(r.features, "<u2").astype(np.int64) for r in train]
    number = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights, intercept = _fit_weights(number, np.concatenate(lists), values, np.array([r.toxic for r in train]))
    return Model(places, weights * values, intercept)


def scorer(model: Model | None):
    """A column function from texts to scores."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(texts)))
        words = texts.to_pylist()
        parts = [model.scores([t or "" for t in words[at : at + 256]]) for at in range(0, len(words), 256)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted."""
    score = scorer(fit(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col).alias("id"), score(F.col(text_col)).alias("score"))
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = scorer(fit(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col)) < LIMIT)
