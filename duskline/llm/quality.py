"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ... The
features x are the relative frequencies of hashed byte trigrams of the text, and a few frequencies of surface forms
(symbols, capitals, digits, repeated and distinct words, length). Expected grade and tail probability select documents.

The fit takes a bounded hash sample of rated documents (``TRAIN_DOCS`` a grade) and runs on the driver over their hashed
features; scoring covers all bytes of all texts, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import append_columns, byte_slices, hashed_sample
from duskline.llm.hashing import word_hashes

BUCKETS, SURFACE = 1 << 12, 8
#: Bound of the fit: rated documents of each grade, about.
TRAIN_DOCS = 1500
_KIND = np.zeros(256, np.uint8)  # 1: symbol, 2: capital, 3: digit
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket of the trigram that starts at each byte, whether it ends inside its own text, and the number of such
    trigrams of each text (none in texts of less than three bytes)."""
    x = data.astype(np.uint32)
    gram = x.copy()
    gram[:-1] |= x[1:] << np.uint32(8)
    gram[:-2] |= x[2:] << np.uint32(16)
    inside = np.ones(len(data), bool)
    size = np.diff(offsets)
    for back in (1, 2):
        inside[offsets[1:][size >= back] - back] = False
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int32), inside, np.maximum(size - 2, 0)


def _surface(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Surface frequencies of each text: symbols, capitals, digits, bars, word equal to the one before, share of words
    that repeat an earlier one, log of the length, presence."""
    n = len(offsets) - 1
    out = np.zeros((n, SURFACE))
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    starts = offsets[full]
    kind = _KIND[data]
    for i, hit in enumerate((kind == 1, kind == 2, kind == 3, data == 124)):
        out[full, i] = np.add.reduceat(hit, starts, dtype=np.int64) / size[full]
    words, doc = word_hashes(data, offsets)
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out[:, 4] = np.bincount(doc[1:][same], minlength=n) / count
    key = np.sort((words >> np.uint64(12)) | doc.astype(np.uint64) << np.uint64(52))
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[first] >> np.uint64(52)).astype(np.int64), minlength=n)
    out[full, 5] = (1 - distinct / np.maximum(np.sqrt(count * np.minimum(count, 400.0)), distinct))[full]
    out[full, 6] = np.log1p(size[full]) / 12
    out[full, 7] = 1
    return out * 4


@dataclass
class OrdinalModel:
    """Weights of the trigram buckets and of the surface features, and ordered thresholds (grades less one)."""

    buckets: np.ndarray
    surface: np.ndarray
    thresholds: np.ndarray

    def latent(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = (_surface(data, offsets) * self.surface).sum(1)  # row by row, so that no sum depends on the slice
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            bucket, inside, count = _trigrams(data, offsets)
            out[full] += np.add.reduceat(np.where(inside, self.buckets[bucket], np.float32(0)), offsets[full]) / np.maximum(count[full], 1)
        return out

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: ``[texts, grades - 1]``."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -60, 60)))


def fit(docs: DataFrame, ratings: DataFrame, docs_per_grade: int = TRAIN_DOCS, steps: int = 250, ridge: float = 1e-4) -> OrdinalModel | None:
    """Fit on the texts of ``docs`` (doc_id, text) that ``ratings`` (doc_id, grade 0, 1, ...) rates; rows without a grade are
    left out; None without two grades. Of contradicting ratings of an id the lowest counts. The ratings are sampled first,
    so that only the sample's texts are moved; other columns are ignored."""
    rated = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = hashed_sample(rated, "grade", docs_per_grade)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_slices(batch.column(1)):
                n = last - first
                bucket, inside, size = _trigrams(data, offsets)
                doc = np.repeat(np.arange(n), size)
                key, count = np.unique(doc * BUCKETS + bucket[inside], return_counts=True)
                cuts = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
                size = np.maximum(size, 1)
                at = [(key[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                share = [(count[a:b] / size[i]).astype(np.float32).tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                surface = [row.tobytes() for row in _surface(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(at, pa.binary()), pa.array(share, pa.binary()), pa.array(surface, pa.binary())], names=["grade", "at", "share", "surface"])

    rows = sample.select(F.col("grade").cast("int"), "text").mapInArrow(features, "grade int, at binary, share binary, surface binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r.grade, r["at"], r.share, r.surface))  # sums do not follow the partitioning
    grade = np.array([r.grade for r in rows], int)
    if len(set(grade.tolist())) < 2:
        return None
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    share = np.concatenate([np.frombuffer(r.share, np.float32) for r in rows]).astype(float) * _SCALE
    surface = np.stack([np.frombuffer(r.surface, float) for r in rows])
    owner, at = np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.concatenate(at)
    top = int(grade.max())
    weight = (1 / np.bincount(grade, minlength=top + 1)[grade]) / len(set(grade.tolist()))  # grades count alike
    w, v = np.zeros(BUCKETS), np.zeros(SURFACE)
    gap = np.concatenate(([0.0], np.full(top - 1, -0.5)))  # thresholds: the first, then positive steps exp(gap)
    state = [np.zeros(BUCKETS + SURFACE + top) for _ in range(2)]
    for step in range(1, steps + 1):
        thresholds = np.concatenate((gap[:1], gap[0] + np.cumsum(np.exp(gap[1:]))))
        latent = np.bincount(owner, w[at] * share, len(rows)) + surface @ v
        tail = 1 / (1 + np.exp(np.clip(thresholds - latent[:, None], -60, 60)))
        # Cumulative link: the likelihood of grade g is P(>= g) - P(>= g + 1).
        above = np.hstack((np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))))
        slope = above * (1 - above)
        here, rows_at = np.maximum(above[np.arange(len(rows)), grade] - above[np.arange(len(rows)), grade + 1], 1e-9), np.arange(len(rows))
        lower, upper = slope[rows_at, grade] / here * weight, slope[rows_at, grade + 1] / here * weight
        d_latent = -(lower - upper)
        d_t = np.array([(lower[grade == k].sum() if k else 0) - (upper[grade == k - 1].sum() if k else 0) for k in range(1, top + 1)])
        d_gap = np.concatenate(([d_t.sum()], [d_t[i:].sum() * np.exp(gap[i]) for i in range(1, top)]))
        grad = np.concatenate((np.bincount(at, d_latent[owner] * share, BUCKETS) + ridge * w, surface.T @ d_latent + ridge * v, d_gap))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, v, gap = w - move[:BUCKETS], v - move[BUCKETS : BUCKETS + SURFACE], gap - move[BUCKETS + SURFACE :]
    thresholds = np.concatenate((gap[:1], gap[0] + np.cumsum(np.exp(gap[1:]))))
    return OrdinalModel((w * _SCALE).astype(np.float32), v, thresholds)


_SCALE = 20.0


def grade_texts(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", least: float = 0.5, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_top`` (P of the highest grade), ``p_pass`` (P of grade 1 or more) and ``selected``
    (``p_pass >= least``; ties are selected).

    Null texts count as empty: they get the thresholds' own probabilities but are never selected. Without a model all
    probabilities are 0. Repeated rows are graded each, equal texts alike. An empty table gives an empty result. Extra
    columns stay; ones named like the new columns are replaced.
    """
    fields = [*(T.StructField(c, T.DoubleType()) for c in ("expected_grade", "p_top", "p_pass")), T.StructField("selected", T.BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        texts = batch.column(batch.schema.get_field_index(text_col))
        out = np.zeros((len(texts), 3))
        some = np.zeros(len(texts), bool)
        for first, last, data, offsets in byte_slices(texts):
            some[first:last] = np.diff(offsets) > 0
            if model:
                tails = model.tails(model.latent(data, offsets))
                out[first:last] = np.stack((tails.sum(1), tails[:, -1], tails[:, 0]), 1)
        return [pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2]), pa.array((out[:, 2] >= least) & some & (model is not None))]

    return append_columns(docs, fields, compute, without)
