"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, neighbouring word pairs and pairs with one word between, hashed to 2**20 buckets.
Training goes through a bounded sample of labelled rows in one task (the sequence matters to FTRL); per-coordinate
rates and the L1 term leave few weights, which are broadcast as (bucket, weight) pairs, at most 2**20 of them.
Scoring reads every text once, whole, without a shuffle.

Defined results: null and empty texts have no features and score the model's prior; rows are scored one by one, so
repeated rows and ids change nothing; a null id is never learned from and counts as held out; without rows of both
classes to learn from, or if nothing is learned from them, every score is PRIOR, so nothing is predicted toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinora.llm.batches import code_points, record, text_slices, texts_of
from kinora.llm.words import gram_features

BITS = 20
STEP_BYTES = 1 << 20
#: Labelled rows learned from, at most, of each class; taken in the order of a hash of the id.
SAMPLE_ROWS = 12_000

#: Bytes of features that are learned from, four for each feature of a row; rows beyond it, in the order of a hash, are not.
SAMPLE_BYTES = 192 << 20
#: A toxic row counts as much as it is rarer, up to so many times.
RAREST = 3.0
#: The score of every text if there is no model.
PRIOR = 0.01


class Ftrl:
    """Follow the regularised leader, proximal form (McMahan et al., 2013), for binary features."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, features: np.ndarray, label: int, importance: float = 1.0) -> float:
        at = np.append(features, len(self.z) - 1)  # the last coordinate is the intercept
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = importance * (p - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that may be learned from."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` learnable documents of each class."""
    kept = learnable(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return kept.where("toxic = 1").orderBy(*order).limit(rows).unionByName(kept.where("toxic = 0").orderBy(*order).limit(rows))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, passes: int = 4) -> DataFrame:
    """The learned weights as (bucket, weight); bucket 2**BITS is the intercept.

    The sample holds the classes at rates of their own, so the intercept is corrected to the odds of all learnable rows.
    """
    counts = {r.toxic: r.n for r in learnable(labels).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # how many rows a toxic row of the sample stands for, by how many a clean one does
    stands = max(1.0, counts.get(1, 0) / sample_rows) / max(1.0, counts.get(0, 0) / sample_rows) if len(counts) == 2 else 1.0
    chosen = F.broadcast(sample(labels, sample_rows))  # 2 * sample_rows rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                _, points, offsets = code_points(texts_of(part))
                bucket, text = gram_features(points, offsets, BITS)
                pairs = np.unique(text << BITS | bucket)
                text, bucket = pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = [bucket[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(lists, pa.binary())], names=["doc_id", "toxic", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for label, packed in zip(b.column("toxic").to_pylist(), b.column("buckets").to_pylist()):
                if held < SAMPLE_BYTES:
                    rows.append((label, packed))
                    held += len(packed)
        toxic = sum(label for label, _ in rows)
        clean = len(rows) - toxic
        if not toxic or not clean:
            return
        model = Ftrl(1 << BITS)
        rarer, rarer_of_all = (min(RAREST, max(1.0, clean / max(toxic * k, 1))) for k in (1.0, stands))
        for _ in range(passes):
            for label, packed in rows:
                model.update(np.frombuffer(packed, dtype=np.int32), label, rarer if label else 1.0)
        weights = model.weights(slice(None))
        weights[-1] += np.log(stands * rarer_of_all / rarer)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], names=["bucket", "weight"])

    rows = texts.mapInArrow(features, "doc_id long, toxic int, buckets binary")
    # by another hash than that of the sample, which would put the class first that is sampled more thinly
    mixed = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "buckets")
    return mixed.mapInArrow(learn, "bucket long, weight double")


class Scorer:
    """The model as a task holds it: all weights by bucket."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray):
        self.table = np.zeros((1 << BITS) + 1)
        self.table[bucket] = weight
        self.light = (self.table != 0)[: 1 << BITS]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and how many distinct weighted features each text has."""
        _, points, offsets = code_points(texts)
        bucket, text = gram_features(points, offsets, BITS)
        hit = self.light[bucket]
        pairs = np.unique(text[hit] << BITS | bucket[hit])
        text, bucket = pairs >> BITS, pairs & ((1 << BITS) - 1)
        total = self.table[-1] + np.bincount(text, weights=self.table[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35))), np.bincount(text, minlength=len(texts))


def _shared(weights: DataFrame):
    model = weights.toArrow()  # L1 leaves few; 2**BITS + 1 rows at most
    if not model.num_rows:
        return weights.sparkSession.sparkContext.broadcast((np.array([1 << BITS], dtype=np.int32), np.array([np.log(PRIOR / (1 - PRIOR))])))
    return weights.sparkSession.sparkContext.broadcast((model.column("bucket").to_numpy().astype(np.int32), model.column("weight").to_numpy().astype(np.float64)))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, n_weighted (distinct weighted features found)."""
    bound = _shared(weights)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id").cast("long"), 5) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_weighted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*bound.value)
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                p, n = scorer(texts_of(part))
                yield record(schema, part.column("doc_id"), part.column("held_out"), p, (p >= 0.5).astype(np.int32), n)

    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_weighted long")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, sample_rows))


def clean(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score 0.5, as without any evidence, or less."""
    bound = _shared(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*bound.value)
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                yield part.filter(pa.array(scorer(texts_of(part))[0] <= 0.5))

    return docs.mapInArrow(run, docs.schema)
