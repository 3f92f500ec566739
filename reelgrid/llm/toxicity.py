"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, neighbouring word pairs and
pairs with one word between them, hashed into ``2**bits`` coordinates.
Training visits a bounded sample of labelled documents (``sample`` of them,
the smallest by a hash of doc_id, one row each) in hash order, with one
learning rate per coordinate and L1 sparsity.  The few weights that stay non-zero are sent
to the executors; scoring is one map over the corpus without a shuffle.

Defined cases: a NULL or empty text has only the bias and is not toxic
unless the bias alone says so; NULL labels and labels of absent documents
are not trained on; where one doc_id has several labels the largest
counts; of rows with one doc_id only the least text is trained on (so the
sample bounds rows), but all are scored, each for itself; rows with a NULL doc_id are scored, never trained on; an empty labels table gives a
model that rejects nothing.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import pick, place, positional

_U = np.uint64


@dataclass(frozen=True)
class Params:
    bits: int = 20
    #: Bound on the labelled documents, and so on the rows, that are trained on.
    sample: int = 40_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    threshold: float = 0.3


def grams(t: tk.Tokens, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and text index of every n-gram and skip-gram, repeats included."""
    h, shift = t.hash, _U(64 - bits)
    doc = t.doc
    parts, docs = [h >> shift], [doc]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (h[:-gap] * _U(salt)) ^ (h[gap:] * _U(salt | 7) + _U(gap))
            pair ^= pair >> _U(29)
            pair *= _U(0x9E3779B97F4A7C15)
            parts.append((pair >> shift)[same])
            docs.append(doc[:-gap][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.slices(batch, 2):
                f, d = grams(tk.tokenize(p.column(2)), bits)
                both = np.unique((d << bits) | f)
                offs = np.searchsorted(both >> bits, np.arange(len(p) + 1))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), lists], ["ord", "label", "features"])

    return run


def ftrl(rows: list[tuple[float, np.ndarray]], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and weights; the last coordinate, 2**bits, is the bias."""
    dim = 1 << p.bits
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0.0
        return w

    for _ in range(p.epochs):
        for y, idx in rows:
            at = np.append(idx, dim)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, w.sum())))) - y
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    keep = np.flatnonzero(w)
    return keep, w[keep]


def _train(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, order = [], []
        for b in batches:
            offs, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            labels = b.column(1).to_numpy(zero_copy_only=False)
            order += b.column(0).to_pylist()
            rows += [(float(labels[i]), flat[offs[i] : offs[i + 1]].astype(np.int32)) for i in range(len(b))]
        if rows:
            at, w = ftrl([rows[i] for i in sorted(range(len(rows)), key=order.__getitem__)], p)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["coordinate", "weight"])

    return run


def sampled_labels(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids, the smallest by hash; one label an id."""
    rows = pick(labels, doc_id="doc_id:bigint", label=f"{target}:double").dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), target: str = "toxic") -> dict[str, np.ndarray]:
    """Fits the model; the sample is bounded by ``params.sample``, so it can be broadcast and trained on in one task."""
    rows = pick(docs, doc_id="doc_id:bigint", text="text").where("doc_id is not null and text is not null")
    known = rows.join(F.broadcast(sampled_labels(labels, target, params.sample)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    order = F.concat(*[F.lpad(F.hex(F.xxhash64(c)), 16, "0") for c in ("doc_id", "text")])
    feats = known.select(order.alias("ord"), "label", "text").mapInArrow(_features(params.bits), "ord string, label double, features array<int>")
    out = feats.repartition(1).mapInArrow(_train(params), "coordinate bigint, weight double").toPandas()
    return {"at": out["coordinate"].to_numpy(np.int64), "weight": out["weight"].to_numpy(float), "bits": np.int64(params.bits)}


def score_batch(col: pa.Array, dense: np.ndarray, bits: int) -> np.ndarray:
    """Probability for each text; ``dense`` has the bias last."""
    f, d = grams(tk.tokenize(col), bits)
    hit = np.flatnonzero(dense[f])
    both = np.unique((d[hit] << bits) | f[hit])
    s = np.bincount(both >> bits, weights=dense[both & ((1 << bits) - 1)], minlength=len(col)) + dense[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))


def _dense(model: dict[str, np.ndarray]) -> np.ndarray:
    dense = np.zeros((1 << int(model["bits"])) + 1)
    dense[-1] = -35.0 if not len(model["at"]) else 0.0
    dense[model["at"]] = model["weight"]
    return dense


def _scorer(shared: Broadcast, text: int, threshold: float, keep_clean: bool | None):
    """keep_clean: None adds the score; True keeps clean rows as they are; False keeps toxic ones with the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bits = _dense(shared.value), int(shared.value["bits"])
        for batch in batches:
            for p in tk.slices(batch, text):
                s = score_batch(p.column(text), dense, bits)
                if keep_clean:
                    yield p.filter(pa.array(s < threshold))
                else:
                    out = pa.RecordBatch.from_arrays([p.column(0), pa.array(np.round(s, 6))], ["doc_id", "toxicity"])
                    yield out if keep_clean is None else out.filter(pa.array(s >= threshold))

    return run


def scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, toxicity) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return pick(docs, doc_id="doc_id:bigint", text="text").mapInArrow(_scorer(shared, 1, 0.0, None), "doc_id bigint, toxicity double")


def rejected(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = Params.threshold) -> DataFrame:
    """(doc_id, toxicity) of the rows whose probability reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return pick(docs, doc_id="doc_id:bigint", text="text").mapInArrow(_scorer(shared, 1, threshold, False), "doc_id bigint, toxicity double")


def drop_toxic(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = Params.threshold) -> DataFrame:
    """The rows below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flat = positional(docs)
    return flat.mapInArrow(_scorer(shared, place(docs, "text"), threshold, True), flat.schema).toDF(*docs.columns)
