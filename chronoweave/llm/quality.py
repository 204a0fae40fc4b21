"""Quality classifier: n-gram indicators scaled by class log-count ratios, hinge loss fitted by dual coordinate descent.

Counts for the ratios cover every labelled training row and are summed on Spark
per hashed n-gram, so what comes back is bounded by the hash space. The hinge
model is fitted on at most ``sample_per_class`` rows of each class, those with the
smallest hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches, text_bytes
from chronoweave.operators.staging import stage

SPACE_BITS, ORDERS = 17, (1, 2, 3, 4)
SAMPLE_PER_CLASS, EPOCHS, COST, SMOOTH = 1500, 8, 1.0, 1.0
PIECE = 1 << 20


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed byte n-grams of a whole text; ``seen`` is a cleared scratch array and is left cleared."""
    shift, top = np.uint32(32 - SPACE_BITS), max(ORDERS)
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text[at:at + PIECE + top - 1], np.uint8).astype(np.uint32) + np.uint32(1)
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, top + 1):
            if len(b) < n:
                break
            gram = gram[:len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1:]
            if n in ORDERS:
                seen[((gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> shift] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


@dataclass
class Model:
    """Weights per hashed n-gram, intercept, and the scale and offset that turn margins into probabilities."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        return float(r @ self.weight[f]) / (float(np.sqrt(r @ r)) or 1.0) + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -30, 30))))


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ratios per hashed n-gram and the number of rows of each class, over all of ``rows(text, quality)``."""
    space = 1 << SPACE_BITS

    def count(batches):
        c, n, seen = np.zeros((2, space), np.int64), np.zeros(2, np.int64), np.zeros(space, bool)
        for b in batches:
            for t, q in zip(text_bytes(b.column("text")), b.column("quality").to_pylist()):
                c[q][features(t or b"", seen)] += 1
                n[q] += 1
        at = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(c[0][at], n[0])), pa.array(np.append(c[1][at], n[1]))], ["f", "c0", "c1"])

    got = rows.mapInArrow(count, "f long, c0 long, c1 long").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()  # at most a row per hash value
    c, n = np.zeros((2, space)), np.zeros(2)
    for k in (0, 1):
        v = got[f"c{k}"].to_numpy(np.float64)
        f = got["f"].to_numpy(np.int64)
        c[k][f[f >= 0]] = v[f >= 0]
        n[k] = v[f < 0].sum()
    p, q = c[1] + SMOOTH, c[0] + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum()), n


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, space: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent with class-balanced costs; the intercept is a constant feature."""
    w, bias, a = np.zeros(space), 0.0, np.zeros(len(y))
    upper = cost * len(y) / (2.0 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i]
            new = min(max(a[i] - (y[i] * (w[f] @ v + bias) - 1.0) / norm[i], 0.0), upper[i])
            step = (new - a[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin) by weighted Newton steps; a slope is never negative."""
    s, o, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(s * margin + o, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + 1e-3 * s, g.sum() + 1e-3 * o])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        s, o = s - np.clip(step[0], -2, 2), o - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(s, 1e-6), o


def agreed_labels(labels: DataFrame) -> DataFrame:
    """``id, quality``: ids with one agreed label of 0 or 1."""
    return labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("low"), F.max("quality").cast("int").alias("quality")).where("low = quality").select("id", "quality")


def fit(docs: DataFrame, labels: DataFrame, train, doc_id: str = "doc_id", text: str = "text", sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on labelled rows whose id passes ``train`` (a function of the id column).

    Texts meet their labels in one sort-merge join, planned alike at every size;
    the sampled ids, at most two per ``sample_per_class``, are broadcast. Of
    documents that share a sampled id one stands in the sample. Without labels of
    both classes every text scores the share of label 1, or 0.5 without any.
    """
    chosen = stage(agreed_labels(small_batches(labels)).where(train(F.col("id"))), "labels")
    mine = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(train(F.col("id")))
    ratio, n = log_count_ratios(mine.join(chosen.hint("merge"), "id"))
    space = len(ratio)
    if not n.all():
        p = (n[1] + 0.5) / (n.sum() + 1.0)
        return Model(ratio, np.zeros(space), 0.0, 1e-6, float(np.log(p / (1 - p))))
    ids = None
    for q in (0, 1):
        part = chosen.where(f"quality = {q}").orderBy(F.xxhash64("id"), "id").limit(sample_per_class)
        ids = part if ids is None else ids.unionByName(part)

    def featurise(batches):
        seen = np.zeros(space, bool)
        for b in batches:
            found = [features(t or b"", seen).astype(np.int32) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), pa.array(found, pa.list_(pa.int32()))], ["id", "quality", "f"])

    got = mine.join(F.broadcast(ids), "id").mapInArrow(featurise, "id long, quality int, f array<int>").groupBy("id", "quality").agg(
        F.min_by("f", F.xxhash64("f")).alias("f")).orderBy("id").toArrow()  # a row per sampled id
    flat = got.column("f").combine_chunks()
    lists = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in flat]
    y = np.where(got.column("quality").to_numpy() > 0, 1.0, -1.0)
    rows = []
    for f in lists:
        r = ratio[f]
        rows.append((f, r / (np.sqrt(r @ r) or 1.0)))
    margins = np.zeros(len(y))
    for fold in (0, 1):
        inside = np.flatnonzero(np.arange(len(y)) % 2 != fold)
        w, b = fit_hinge([rows[i] for i in inside], y[inside], space)
        for i in np.flatnonzero(np.arange(len(y)) % 2 == fold):
            margins[i] = w[rows[i][0]] @ rows[i][1] + b
    share = np.where(y > 0, n[1] / max(1, (y > 0).sum()), n[0] / max(1, (y < 0).sum()))  # sampled rows stand for their class
    slope, offset = fit_sigmoid(margins, y, share * len(y) / share.sum())
    w, b = fit_hinge(rows, y, space)
    return Model(ratio, w, b, slope, offset)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add P(label 1) of each whole text; null texts score as empty ones. All other columns pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # three arrays of the hash space

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        m = held.value
        seen = np.zeros(len(m.ratio), bool)
        return pa.array([m.score(features(t or b"", seen)) for t in text_bytes(column)], pa.float64())

    return small_batches(docs).withColumn(out, score(F.col(text)))
