"""Toxicity by non-negative positive-unlabelled learning.

A linear scorer over word presence is trained from confirmed toxic documents
(positive) and unlabelled text (training documents drawn whatever their label) with the non-negative risk estimator
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``, logistic loss and numpy Adam
steps; where the corrected negative part falls below zero its gradient is
reversed.  The class prior pi is a parameter; by default it is the share of
toxic rows among the labelled training rows.  Features are the hashed distinct
lower-cased words of the whole text; the words used are those in at least
``MIN_DF`` of the sampled positives.  The sample is at most ``SAMPLE_POSITIVE``
positives and ``SAMPLE_UNLABELLED`` others, by hash of the id.

Scoring is one map over all documents with the weight table (``1 << BITS``
numbers).  Defined results: null and empty texts get the score of a text
without features; without a positive training row every score is 0; doc_ids
that are null or not in the labels are unlabelled; several labels of one
doc_id count as toxic if any is 1; repeated rows each get a row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .langid import held_out

BITS = 20
SAMPLE_POSITIVE = 4_000
SAMPLE_UNLABELLED = 20_000
MIN_DF = 8
THRESHOLD = 0.7
STEPS = 600


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct lower-cased words of a chunk, by document."""
    w = K.Words(K.LOWER[raw], offsets, K.ALNUM)
    key = (w.names() >> np.uint64(64 - BITS)).astype(np.int64) + (w.doc().astype(np.int64) << BITS)
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def _featurise(batches, text: str):
    for batch in K.chunks(batches, text):
        doc, bucket = buckets(*K.utf8(batch.column(batch.schema.names.index(text))))
        edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        packed = pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        keep = [k for k, x in enumerate(batch.schema.names) if x == "toxic"]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [packed], ["toxic", "x"])


class Scorer:
    """Weights by bucket and a bias."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = -np.inf):
        self.weights, self.bias = weights, bias

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
            steps: int = STEPS, rate: float = 0.05, penalty: float = 4e-5, min_df: int = MIN_DF):
        if not positive:
            return self
        df = np.bincount(np.concatenate(positive), minlength=1 << BITS)
        used = np.flatnonzero(df >= min(min_df, max(1, len(positive) // 4)))
        place = np.full(1 << BITS, -1)
        place[used] = np.arange(len(used))
        rows, cols = [], []
        for k, x in enumerate([*positive, *unlabelled]):
            c = place[x]
            cols.append(c[c >= 0])
            rows.append(np.full(len(cols[-1]), k))
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        n, n_p, n_u = len(positive) + len(unlabelled), len(positive), max(len(unlabelled), 1)
        is_p = np.arange(n) < n_p
        w, b = np.zeros(len(used)), 0.0
        m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, steps + 1):
            g = np.bincount(rows, w[cols], n) + b
            g = np.clip(g, -30, 30)
            up = 1 / (1 + np.exp(-g))
            as_negative = np.logaddexp(0, g)
            # the negatives' risk: that of all text less the positives' part of it
            negative = as_negative[~is_p].sum() / n_u - prior * as_negative[is_p].sum() / n_p
            if negative >= 0:
                d = np.where(is_p, -prior / n_p, up / n_u)
            else:
                d = np.where(is_p, prior * up / n_p, -up / n_u)
            grad = np.append(np.bincount(cols, d[rows], len(used)) + penalty * np.sign(w), d.sum())
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            delta = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
            w, b = w - delta[:-1], b - delta[-1]
        self.weights, self.bias = np.zeros(1 << BITS), float(b)
        self.weights[used] = w
        return self

    def score(self, doc, bucket, n: int) -> np.ndarray:
        if self.weights is None:
            return np.zeros(n)
        g = np.bincount(doc, self.weights[bucket], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          prior: float | None = None) -> Scorer:
    """Fit on training rows (crc32 of the id mod 3 is not 1)."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = known.agg(F.count("toxic").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not stats.p:
        return Scorer()
    prior = stats.p / stats.n if prior is None else prior
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(3))
    positive = known.filter((F.col("toxic") == 1) & (F.pmod(draw, F.lit(stats.p)) < SAMPLE_POSITIVE)).select(
        "doc_id", F.lit(1).alias("toxic"))
    # the drawn ids go to the texts, as long as the draw is as small as it should be
    few = positive.count() <= 2 * SAMPLE_POSITIVE
    first = rows.join(F.broadcast(positive) if few else positive, "doc_id").select("toxic", "text")
    other = rows.filter(F.pmod(draw, F.lit(max(rows.count(), 1))) < SAMPLE_UNLABELLED).select(
        F.lit(0).alias("toxic"), "text")
    # an id may have many rows: the bound keeps the same ones in every run
    got = [drawn.mapInArrow(lambda b: _featurise(b, "text"), "toxic int, x binary").orderBy("x").limit(2 * bound).toArrow()
           for drawn, bound in ((first, SAMPLE_POSITIVE), (other, SAMPLE_UNLABELLED))]
    p, u = ([np.frombuffer(x, np.int32) for x in t["x"].to_pylist()] for t in got)
    return Scorer().fit(p, u, prior)


def _score(batches, scorer: Scorer, text: str, threshold: float):
    names = ["score", "predicted"]
    for batch in K.chunks(batches, text):
        raw, offsets = K.utf8(batch.column(batch.schema.names.index(text)))
        score = scorer.score(*buckets(raw, offsets), batch.num_rows)
        kept = [k for k, x in enumerate(batch.schema.names) if x not in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in kept] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))],
            [batch.schema.names[k] for k in kept] + names)


def score_toxicity(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``predicted`` (columns of these names give way)."""
    docs, schema = K.fields(K.bounded(docs), "score double, predicted int")
    return docs.mapInArrow(lambda b: _score(b, scorer, text, threshold), schema)


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"))), scorer).select(
        "doc_id", "held_out", "score", "predicted")
