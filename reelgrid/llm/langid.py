"""Language identification with language-bitmask n-gram filters.

An n-gram is four neighbouring bytes of the folded text, where runs of
bytes that are neither letters nor digits count as one blank.  Training
counts every n-gram by language over all labelled texts; a language keeps
the n-grams that make up at least ``share`` of its own, and whose share is
at least ``margin`` of the n-gram's largest share in any language.

The filter is bit-sliced: ``2**bits`` slots of one bit a language, in
words of 64 languages, so its size grows with the languages alone.  An
n-gram sets its languages' bits in ``hashes`` slots; reading ANDs the
slots, so one lookup returns every language that has the n-gram.  A text's
lookups are counted by language, each count is corrected for the language's
false positives, and the largest decides; ties go to the first language by
name.  Broadcasting the filter doesn't grow with the rows of the corpus;
only (language, n-gram) pairs above ``share`` are gathered,
of which there are at most 1 / share a language.

Defined cases: NULL and empty texts, texts of fewer than four bytes and
texts no n-gram of which is known get NULL as language and 0 as share;
rows with NULL language aren't trained on; repeated rows count and are
labelled each for itself; an empty table trains an empty filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import pick

_U = np.uint64
_BLANK = 32
_WORD = 64


@dataclass(frozen=True)
class Params:
    bits: int = 20
    hashes: int = 2
    share: float = 2e-5
    margin: float = 0.2


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram as uint32 and its text's index."""
    data, offs = tk.folded_bytes(col)
    n = len(data)
    if n < 4:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    word = tk._word[data]
    x = np.where(word, data, np.uint8(_BLANK))
    keep = word.copy()
    keep[1:] |= word[:-1]
    heads = offs[:-1]
    heads = heads[heads < n]
    keep[heads] = word[heads]
    at = np.flatnonzero(keep)
    x = x[at].astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    g = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    cuts = np.searchsorted(at, offs)
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    same = doc[3:] == doc[:-3]
    return g[same], doc[:-3][same]


def slots(g: np.ndarray, p: Params) -> list[np.ndarray]:
    """The filter's slots of each n-gram."""
    m = g.astype(_U) * _U(0x9E3779B97F4A7C15)
    m ^= m >> _U(32)
    m *= _U(0xD6E8FEB86659FD93)
    return [((m >> _U(64 - p.bits * (k + 1))) & _U((1 << p.bits) - 1)).astype(np.int64) for k in range(p.hashes)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a piece of rows by language and n-gram."""
    for batch in batches:
        for b in tk.slices(batch, 1, 4 * tk.CHUNK_BYTES):
            langs = b.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            g, doc = grams(b.column(1))
            if len(g):
                key, n = np.unique((codes[doc].astype(_U) << _U(32)) | g.astype(_U), return_counts=True)
                lang = langs.dictionary.take(pa.array((key >> _U(32)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((key & _U(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    rate: np.ndarray
    params: Params


def train(docs: DataFrame, params: Params = Params()) -> Model:
    """Counts over all labelled texts; gathers what the filter holds."""
    p = params
    rows = pick(docs, lang="lang:string", text="text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # one row a language, fewer than the model that is broadcast below; the counts' exchange is read twice, not made twice
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("all"))
    top = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.where(F.col("share") >= p.share).withColumn("top", top).where(F.col("share") >= p.margin * F.col("top"))
    by: dict[str, list[int]] = {}
    for r in kept.select("lang", "gram").toLocalIterator():
        by.setdefault(r.lang, []).append(r.gram)
    langs = sorted(by)
    kind = next(t for w, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (np.inf, np.uint64)) if len(langs) <= w)
    table = np.zeros((-(-len(langs) // _WORD), 1 << p.bits), dtype=kind)
    fill = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        word, bit = divmod(i, _WORD)
        for s in slots(np.array(by[lang], dtype=np.uint32), p):
            table[word, s] |= kind(1 << bit)
        fill[i] = ((table[word] >> kind(bit)) & kind(1)).mean()
    return Model(langs, table, fill**p.hashes, p)


def decide(col: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, -1 for none; its corrected share of n-grams; the n-grams of each text."""
    g, doc = grams(col)
    n = np.bincount(doc, minlength=len(col))
    if not len(g) or not m.langs:
        return np.full(len(col), -1), np.zeros(len(col)), n
    at = slots(g, m.params)
    ends = np.cumsum(n)
    sums = np.zeros(len(g) + 1, dtype=np.int64)
    found = np.zeros((len(m.langs), len(col)))
    for i in range(len(m.langs)):
        word, bit = divmod(i, _WORD)
        if not bit:
            mask = m.table[word][at[0]]
            for s in at[1:]:
                mask &= m.table[word][s]
        np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), out=sums[1:])
        hits = sums[ends] - sums[ends - n]
        found[i] = np.maximum(hits - n * m.rate[i], 0) / (1 - m.rate[i])
    best = found.argmax(axis=0)
    share = found[best, np.arange(len(col))] / np.maximum(n, 1)
    return np.where(share > 0, best, -1), share, n


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, predicted, share, ngrams) for every row."""
    shared, params = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.rate)), model.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value, params)
        names = pa.array(m.langs, pa.string())
        for batch in batches:
            for b in tk.slices(batch, 1):
                best, share, n = decide(b.column(1), m)
                lang = names.take(pa.array(best, pa.int64(), mask=best < 0))
                yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(np.round(share, 6)), pa.array(n)], ["doc_id", "predicted", "share", "ngrams"])

    return pick(docs, doc_id="doc_id:bigint", text="text").mapInArrow(run, "doc_id bigint, predicted string, share double, ngrams bigint")
