"""Quality selection by importance resampling.

Word unigrams and bigrams are hashed into ``BUCKETS`` buckets. Two bag models are
counted, one over the target text (documents labelled good) and one over all
documents; a document's log-weight is the log-ratio of its probabilities under the
two, the sum over its n-grams. Gumbel noise from a hash of the identifier is added
and the largest keys are taken: a sample without replacement in proportion to the
weights. With ``effective`` n-grams given, all documents are weighed as if they
were that long (their mean log-ratio times ``effective``), so that length alone
does not decide.

The counts cover every document; tasks send one row per bucket. The models are
two vectors of fixed size. The cutoff of the sample is found by counting keys in
ranges, so no list of keys is gathered anywhere.

The target model is fitted on at most ``MAX_TARGET`` labelled documents, chosen by
a hash of the identifier.

Defined cases: null text is empty; a text without words has weight 0. A null
identifier draws its noise from the empty string. Repeated rows have equal keys.
Rows tied with the last one taken are taken too. Without target documents all
weights are 0 and the sample is uniform. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.llm.textbytes import WordHasher, chunks, flat, mix
from shopspark.storage import materialize

BUCKETS = 1 << 14
FRACTION = 0.85
MAX_TARGET = 20_000
STEPS = 1 << 12


def bounded_sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of their identifier."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def _ngrams(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the number before each text."""
    words, counts = hasher(*flat(texts))
    pairs = mix(words[:-1] + words[1:] * np.uint64(0x9E3779B97F4A7C15))
    text_of = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    inside = text_of[1:] == text_of[:-1]
    owner = np.concatenate([text_of, text_of[:-1][inside]])
    hashes = np.concatenate([words, pairs[inside]])
    order = np.argsort(owner, kind="stable")
    return (hashes[order] >> np.uint64(50)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(counts)))


def _count(batches) -> Iterator[pa.RecordBatch]:
    hasher, counts = WordHasher(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            buckets, offsets = _ngrams(hasher, part.column(1))
            good = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))
            counts[0] += np.bincount(buckets, minlength=BUCKETS)
            counts[1] += np.bincount(buckets[good], minlength=BUCKETS)
    seen = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Smoothed log-ratio of the target model to the model of all documents, by bucket.

    docs: id, text. target_ids: id, bounded by the caller.
    """
    marked = docs.join(F.broadcast(target_ids.select("id").distinct().withColumn("good", F.lit(True))), "id", "left")
    rows = marked.select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    counted = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket")
    counts = np.zeros((2, BUCKETS))
    for row in counted.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows at most
        counts[:, row.bucket] = row.raw, row.target
    raw, target = counts
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _weigh(ratios: np.ndarray, effective: float | None):
    def weigh(batches) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in chunks(batch, "text"):
                buckets, offsets = _ngrams(hasher, part.column(1))
                sizes = np.diff(offsets)
                totals = np.concatenate([[0.0], np.cumsum(ratios[buckets])])
                weights = totals[offsets[1:]] - totals[offsets[:-1]]
                if effective is not None:
                    weights = weights / np.maximum(sizes, 1) * effective
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(weights)], names=["id", "n_grams", "log_weight"])

    return weigh


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the identifier."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return -F.log(-F.log(u))


def kth_largest(stored: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting values in ever smaller ranges of equal width.

    Each round is one counting pass whose result has ``STEPS`` rows at most. It ends
    when the range that holds the value has no two different ones.
    """
    low, high, n = stored.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / STEPS
        inside = stored.where((F.col(column) >= low) & (F.col(column) <= high))
        step = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(STEPS - 1)) if width > 0 else F.lit(0)
        ranges = inside.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(ranges.collect(), key=lambda r: -r.step):
            if k <= row.n:
                low, high = row.low, row.high
                break
            k -= row.n
        if width <= 0:
            break
    return low


def importance_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fraction: float = FRACTION, seed: int = 0, max_target: int = MAX_TARGET, effective: float | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, n_grams, log_weight, key, kept.

    ``labels`` has ``id_col`` and a label that is 1 for target documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    target = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id is not null")
    target = materialize(bounded_sample(target, "id", max_target), "resampling-target")
    ratios = log_ratios(rows, target)
    kind = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(_weigh(ratios, effective), f"id {kind}, n_grams long, log_weight double")
    weighed = materialize(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("id"), seed)), "resampling-keys")
    cutoff = kth_largest(weighed, "key", round(fraction * weighed.count()))
    kept = F.col("key") >= F.lit(cutoff) if cutoff is not None else F.lit(False)
    return weighed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "key", kept.alias("kept"))
