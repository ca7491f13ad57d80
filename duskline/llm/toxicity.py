"""Toxic spans by a linear-chain conditional random field over words, aggregated to document scores.

Words are runs of letters, lower-cased. Two states (clean, toxic) have transition weights and an emission made of a bias
and the weights of a word's features: the word itself and its first five letters, as far as they were kept in training.
Forward-backward gives each word's probability of being toxic; adjoining words with p >= 0.5 are the offending spans. The
marginals aggregate to 1 - product(1 - p) over words with p >= ``COUNTED``, at least the largest p; the document's score
is that evidence calibrated (a logistic curve of its log odds, fitted to the training documents).

Training needs labelled words, but tables label documents. A word of a toxic document is labelled toxic where documents
with that word are toxic far more often than others (likelihood ratio at least ``STRONG`` and at least ``RATIO`` times as
often); all words of other documents are labelled clean. Weaker associations (``WEAK``) become features without a label.
Segments are weighted so that both kinds of documents count as often as they occur. Counts come from a bounded hash sample
of labelled documents (``TRAIN_DOCS`` of each label, distinct texts) in Spark; the field is then fitted on the driver to at
most ``TRAIN_SEGMENTS`` segments of ``SEGMENT`` words. Scoring covers all words of all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import append_columns, hashed_sample
from duskline.session import cut

#: Bounds of the fit.
TRAIN_DOCS, TRAIN_SEGMENTS, SEGMENT, FEATURES = 4000, 6000, 48, 4000
STRONG, WEAK, RATIO = 16.0, 8.0, 4.0
COUNTED = 0.02
PREFIX = 5
WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:PREFIX]) if len(word) >= PREFIX else (word,)


@dataclass
class ToxicField:
    """Weights of a two-state chain: bias, feature weights (log odds of toxic), transitions (log, from x to)."""

    bias: float
    weights: dict[str, float]
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    quiet: dict[int, float] = field(default_factory=dict)
    ends: list[np.ndarray] = field(default_factory=list)

    def odds(self, words: list[str]) -> tuple[list[float], bool]:
        """exp(emission) of each word and whether any word has a feature."""
        get, bias = self.weights.get, self.bias
        out, live = [], False
        for w in words:
            e = get(w)
            p = get("^" + w[:PREFIX]) if len(w) >= PREFIX else None
            if e is not None or p is not None:
                live = True
                out.append(math.exp(min(bias + (e or 0.0) + (p or 0.0), 30.0)))
            else:
                out.append(math.exp(bias))
        return out, live

    def marginals(self, odds: list[float]) -> list[float]:
        """P(toxic) of each word by forward-backward, on the ratio of the two states."""
        (a00, a01), (a10, a11) = np.exp(self.transitions).tolist()
        forward, f = [], None
        for o in odds:
            f = o if f is None else o * (a01 + f * a11) / (a00 + f * a10)
            forward.append(f)
        out, g = [0.0] * len(odds), 1.0
        for t in range(len(odds) - 1, -1, -1):
            r = forward[t] * g
            out[t] = r / (1 + r)
            x = odds[t] * g
            g = (a10 + a11 * x) / (a00 + a01 * x)
        return out

    def without_features(self, n: int) -> float:
        """Aggregated marginals of ``n`` words that have no feature, computed once a length.

        The forward ratio of a word depends on the words before it only, the backward one on those after it, so the chains
        of all lengths share both sequences.
        """
        if n not in self.quiet:
            if not self.ends or len(self.ends[0]) < n:
                (a00, a01), (a10, a11) = np.exp(self.transitions).tolist()
                o = math.exp(self.bias)
                f, g = [o], [1.0]
                for _ in range(max(2 * n, 1024)):
                    f.append(o * (a01 + f[-1] * a11) / (a00 + f[-1] * a10))
                    g.append((a10 + a11 * o * g[-1]) / (a00 + a01 * o * g[-1]))
                self.ends = [np.array(f), np.array(g)]
            r = self.ends[0][:n] * self.ends[1][:n][::-1]
            if len(self.quiet) > 100_000:
                self.quiet.clear()
            self.quiet[n] = _aggregate((r / (1 + r)).tolist())
        return self.quiet[n]

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Calibrated document score and offending spans (code points); 0 for a text without words."""
        raw, spans = self.evidence(text)
        return (1 / (1 + math.exp(-self.slope * _logit(raw) - self.shift)) if raw else 0.0), spans

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Aggregated marginals and offending spans."""
        words = WORD.findall(text.lower())
        live = self.weights
        if not any(w in live or "^" + w[:PREFIX] in live for w in set(words)):
            return self.without_features(len(words)), []
        found = list(WORD.finditer(text))
        p = self.marginals(self.odds([m.group().lower() for m in found])[0])
        spans: list[tuple[int, int]] = []
        joined = False
        for m, x in zip(found, p, strict=True):
            if x >= 0.5:
                if joined:
                    spans[-1] = (spans[-1][0], m.end())
                else:
                    spans.append(m.span())
            joined = x >= 0.5
        return _aggregate(p), spans


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _aggregate(p: list[float]) -> float:
    if not p:
        return 0.0
    clean = 1.0
    for x in p:
        if x >= COUNTED:
            clean *= 1 - x
    return max(1 - clean, max(p))


def _association(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio of feature against label, and how many times as often it is in toxic as in clean documents."""
    n, with_ = toxic + clean, a + b
    log = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    rest = n - with_
    ratio = 2 * (log(a, with_ * toxic / n) + log(b, with_ * clean / n) + log(toxic - a, rest * toxic / n) + log(clean - b, rest * clean / n))
    times = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
    return np.where(times > 1, ratio, -ratio), times


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = TRAIN_DOCS) -> ToxicField | None:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1; rows with a null are left
    out; None unless both labels occur. Of contradicting labels of an id, and of equal texts, toxic counts. The labels are
    sampled first, so that only the sample's texts are moved; other columns are ignored."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = hashed_sample(usable, "toxic", docs_per_label)
    sample = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = cut(sample.repartition(16))
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    there = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return None

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count: dict[str, list[int]] = {}
            for text, toxic in zip(frame.text, frame.toxic, strict=True):
                for f in {f for w in set(WORD.findall(text.lower())) for f in _features(w)}:
                    count.setdefault(f, [0, 0])[toxic] += 1
            yield pd.DataFrame({"feature": list(count), "b": [c[0] for c in count.values()], "a": [c[1] for c in count.values()]})

    counts = sample.mapInPandas(present, "feature string, b long, a long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = sorted(counts.where("a >= 3").collect())  # bounded by the sample; in the order of names
    a, b = np.array([r.a for r in counts], float), np.array([r.b for r in counts], float)
    strength, times = _association(a, b, sizes[1], sizes[0])
    names = [r.feature for r in counts]
    ranked = [i for i in np.argsort(-strength, kind="stable") if strength[i] >= WEAK and times[i] >= RATIO][:FEATURES]
    kept = {names[i]: k for k, i in enumerate(ranked)}
    toxic_words = {names[i] for i in ranked if strength[i] >= STRONG and not names[i].startswith("^")}

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame.text, frame.toxic, strict=True):
                words = WORD.findall(text.lower())
                for at in range(0, len(words), SEGMENT):
                    part = words[at : at + SEGMENT]
                    ids = [",".join(str(kept[f]) for f in _features(w) if f in kept) for w in part]
                    place = int.from_bytes(blake2b(f"{at} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    rows.append((";".join(ids), "".join("1" if toxic and w in toxic_words else "0" for w in part), any(ids), toxic, place))
            yield pd.DataFrame(rows, columns=["ids", "labels", "live", "toxic", "place"])

    parts = sample.mapInPandas(segments, "ids string, labels string, live boolean, toxic int, place long")
    half = TRAIN_SEGMENTS // 2
    rows = [*parts.where("live").orderBy("place").limit(half).collect(), *parts.where("not live").orderBy("place").limit(half).collect()]
    weight = np.array([there[r.toxic] / sizes[r.toxic] for r in rows])
    chain = _fit_chain([r.ids.split(";") for r in rows], [r.labels for r in rows], weight, list(kept))

    def evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [_logit(chain.evidence(t)[0]) for t in frame.text], "toxic": frame.toxic})

    seen = sample.mapInPandas(evidence, "x double, toxic int").toPandas().sort_values(["x", "toxic"])  # bounded by the sample
    chain.slope, chain.shift = _calibrate(seen.x.to_numpy(), seen.toxic.to_numpy(), np.array([there[k] / sizes[k] for k in seen.toxic]))
    return chain


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y | x) by weighted Newton steps; the slope stays positive."""
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = max(a - np.clip(step[0], -0.5, 0.5), 1e-3), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def _fit_chain(ids: list[list[str]], labels: list[str], weight: np.ndarray, names: list[str], steps: int = 80, lasso: float = 2e-5) -> ToxicField:
    """Maximum conditional likelihood of the labels with an L1 penalty on feature weights."""
    n = len(ids)
    size = np.array([len(x) for x in labels])
    width = int(size.max()) if n else 0
    inside = np.arange(width)[None, :] < size[:, None]
    real = inside * (weight / weight.mean())[:, None] if n else inside.astype(float)
    y = np.zeros((n, width))
    cell, feature = [], []
    for i, (parts, text) in enumerate(zip(ids, labels, strict=True)):
        y[i, : len(text)] = [c == "1" for c in text]
        for t, part in enumerate(parts):
            if part:
                for f in part.split(","):
                    cell.append(i * width + t)
                    feature.append(int(f))
    cell, feature = np.array(cell, int), np.array(feature, int)
    both = real[:, 1:]
    seen = [((1 - y[:, :-1]) * y[:, 1:] * both).sum(), (y[:, :-1] * (1 - y[:, 1:]) * both).sum(), (y[:, :-1] * y[:, 1:] * both).sum()]
    k = len(names)
    theta = np.concatenate((np.zeros(k), [-3.0, 0.0, 0.0, 0.0]))  # features, bias, 01, 10, 11
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emission = np.full(n * width, theta[k])
        emission += np.bincount(cell, theta[feature], n * width) if len(cell) else 0
        o = np.exp(np.clip(emission, -30, 30)).reshape(n, width)
        a01, a10, a11 = np.exp(theta[k + 1 :])
        f, g = np.empty((n, width)), np.ones((n, width))
        for t in range(width):
            f[:, t] = o[:, t] if not t else o[:, t] * (a01 + f[:, t - 1] * a11) / (1 + f[:, t - 1] * a10)
        for t in range(width - 2, -1, -1):
            x = o[:, t + 1] * g[:, t + 1]
            g[:, t] = np.where(inside[:, t + 1], (a10 + a11 * x) / (1 + a01 * x), 1.0)
        p = f * g / (1 + f * g)
        left, x = f[:, :-1], o[:, 1:] * g[:, 1:]
        total = 1 + a01 * x + left * a10 + left * a11 * x
        expected = [(a01 * x / total * both).sum(), (left * a10 / total * both).sum(), (left * a11 * x / total * both).sum()]
        error = ((p - y) * real).reshape(-1)
        grad = np.concatenate((np.bincount(feature, error[cell], k) if k else [], [error.sum()], np.subtract(expected, seen))) / max(n, 1)
        grad[:k] += lasso * np.sign(theta[:k])
        grad[k:] += 1e-4 * theta[k:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {name: float(w) for name, w in zip(names, theta, strict=False) if abs(w) > 0.3}
    return ToxicField(float(theta[k]), weights, np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]]))


def score_toxicity(docs: DataFrame, model: ToxicField | None, text_col: str = "text", threshold: float = 0.3, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 if score >= ``threshold``) and ``toxic_spans`` (``start:end`` in code points).

    Null, empty and letterless texts and any text without a model: score 0, no spans. Whole texts are scored. Repeated rows
    are scored each, equal texts alike. An empty table gives an empty result. Extra columns stay; ones named like the new
    columns are replaced.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.StringType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        found = [model.score(t) if t and model else (0.0, []) for t in texts]
        score = [s for s, _ in found]
        spans = [",".join(f"{a}:{b}" for a, b in x) for _, x in found]
        return [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(spans, pa.string())]

    return append_columns(docs, fields, compute, without)
