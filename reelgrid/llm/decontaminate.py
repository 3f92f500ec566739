"""Benchmark decontamination with suffix arrays of the training text.

Training documents are read in shards of at most ``shard_tokens`` tokens
(a longer document is a shard of its own).  Each shard sorts all its
suffixes, compared up to the longest benchmark item, by prefix doubling on
three-token keys.  Every benchmark suffix that is long enough is then
binary-searched in every shard; the range of suffixes that share its first
``min_match`` tokens gives all locations, each extended to its longest
verbatim match.  A document with a match of ``min_match`` tokens, or of a
whole item that is shorter, is affected.

The benchmark travels to the executors in pieces of at most
``piece_tokens`` tokens; each piece is one pass over the training text, so
a large benchmark costs passes, not memory.

Defined cases: NULL and empty texts match nothing and stay; NULL or empty
items contaminate nothing; items with equal text or id are searched each
for itself; rows that repeat a document are each reported once an item;
rows with NULL doc_id are reported with NULL; an empty benchmark removes nothing.
Of several longest matches the first place in the document and then in the item is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import pick, place, positional

_U = np.uint64


@dataclass(frozen=True)
class Params:
    min_match: int = 13
    shard_tokens: int = 1_000_000
    #: Bound on the benchmark tokens that are sent to the executors at once.
    piece_tokens: int = 2_000_000


def suffix_array(ids: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes, each cut at ``end`` of its text and compared up to ``depth`` tokens.

    ids: positive token numbers; end: for each position the end of its text.
    """
    n = len(ids)
    pos = np.arange(n)
    wide = int(ids.max()).bit_length() if n else 1
    k = min(3, max(1, 63 // wide))
    key = ids.astype(_U)
    for j in range(1, k):
        at = pos + j
        inside = at < end
        key = (key << _U(wide)) | np.where(inside, ids[np.minimum(at, n - 1)], 0).astype(_U)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    ks = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ks[1:] != ks[:-1]
    heads = np.flatnonzero(new)
    group = heads[np.cumsum(new) - 1]
    rank[order] = group
    tied = _tied(new)
    while k < depth and len(tied):
        p = order[tied]
        at = p + k
        second = np.where(at < end[p], rank[np.minimum(at, n - 1)] + 1, 0)
        both = (rank[p].astype(_U) << _U(32)) | second.astype(_U)
        by = np.argsort(both, kind="stable")
        p, both = p[by], both[by]
        order[tied] = p
        new = np.ones(len(p), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        rank[p] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = tied[_tied(new)]
        k *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Places whose group, begun where ``new`` is set, has more than one member."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


@dataclass
class Items:
    """Benchmark items as one token array, and the suffixes to look for."""

    hash: np.ndarray
    offs: np.ndarray
    item: np.ndarray
    start: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], min_match: int) -> Items:
        t = tk.tokenize(pa.array(texts, pa.large_string()))
        size = np.diff(t.offs)
        doc = t.doc
        start = np.arange(len(t.hash))
        left = t.offs[1:][doc] - start
        need = np.minimum(min_match, size[doc])
        ok = left >= need
        return cls(t.hash, t.offs, doc[ok], start[ok], need[ok])


def shard_matches(t_hash: np.ndarray, offs: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(document, item, length, document token, item token) of the longest match of each pair with any."""
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    n, nq = len(t_hash), len(items.start)
    if not n or not nq:
        return empty
    vocab, inv = np.unique(t_hash, return_inverse=True)
    ids = inv.astype(np.int64) + 1
    at = np.minimum(np.searchsorted(vocab, items.hash), len(vocab) - 1)
    known = np.where(vocab[at] == items.hash, at + 1, -1).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(known < 0)])
    q = np.flatnonzero(before[items.start + items.need] == before[items.start])
    end = np.repeat(offs[1:], np.diff(offs))
    depth = int(np.diff(items.offs).max())
    order = suffix_array(ids, end, depth)
    if not len(q):
        return empty
    start, need = items.start[q], items.need[q]
    width = int(need.max())
    cols = np.arange(width)
    qm = np.where(cols < need[:, None], known[np.minimum(start[:, None] + cols, len(known) - 1)], 0)

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), n, dtype=np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            p = order[mid]
            place_ = p[:, None] + cols
            s = np.where(place_ < end[p][:, None], ids[np.minimum(place_, n - 1)], 0)
            s = np.where(cols < need[live][:, None], s, 0)
            differ = s != qm[live]
            first = differ.argmax(axis=1)
            row = np.arange(len(live))
            any_ = differ[row, first]
            less = any_ & (s[row, first] < qm[live][row, first])
            go = less | (~any_ if upper else False)
            lo[live] = np.where(go, mid + 1, lo[live])
            hi[live] = np.where(go, hi[live], mid)
        return lo

    a, b = bound(False), bound(True)
    count = b - a
    if not count.sum():
        return empty
    qi = np.repeat(np.arange(len(q)), count)
    p = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a[qi]]
    s, e = start[qi], items.offs[1:][items.item[q]][qi]
    length = need[qi].copy()
    live = np.arange(len(p))
    while len(live):
        x, y = p[live] + length[live], s[live] + length[live]
        ok = (x < end[p[live]]) & (y < e[live])
        ok[ok] = ids[x[ok]] == known[y[ok]]
        live = live[ok]
        length[live] += 1
    doc = np.searchsorted(offs, p, side="right") - 1
    item = items.item[q][qi]
    dpos, ipos = p - offs[doc], s - items.offs[item]
    by = np.lexsort((ipos, dpos, -length, item, doc))
    doc, item = doc[by], item[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[first], item[first], length[by][first], dpos[by][first], ipos[by][first]


def _shards(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of one shard, their token hashes and the first token of each row."""
    held: list = []
    tokens = 0

    def out() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        sizes = np.concatenate([np.diff(o) for _, _, o in held])
        return pa.Table.from_batches([b for b, _, _ in held]), np.concatenate([h for _, h, _ in held]), np.concatenate([[0], np.cumsum(sizes)])

    for batch in batches:
        for b in tk.slices(batch, text):
            t = tk.tokenize(b.column(text))
            if held and tokens + len(t.hash) > limit:
                yield out()
                held, tokens = [], 0
            held.append((b, t.hash, t.offs))
            tokens += len(t.hash)
    if held:
        yield out()


def _searcher(shared, text: int, limit: int, keep_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *arrays = shared.value
        items = Items(*arrays)
        for rows, h, offs in _shards(batches, text, limit):
            doc, item, length, dpos, ipos = shard_matches(h, offs, items)
            if keep_clean:
                clean = np.ones(len(rows), dtype=bool)
                clean[doc] = False
                yield from rows.filter(pa.array(clean)).to_batches()
            elif len(doc):
                found = [pa.array(rows.column(0).to_numpy()[doc] if not rows.column(0).null_count else np.array(rows.column(0).to_pylist(), dtype=object)[doc], pa.int64()), pa.array([ids[i] for i in item], pa.int64())]
                yield pa.RecordBatch.from_arrays(found + [pa.array(x.astype(np.int32)) for x in (length, dpos, ipos)], ["doc_id", "item_id", "tokens", "doc_start", "item_start"])

    return run


def _plain(ids: list, items: Items) -> tuple:
    return (ids, items.hash, items.offs, items.item, items.start, items.need)


def _pieces(benchmark: DataFrame, p: Params) -> Iterator[tuple]:
    """The benchmark in pieces of at most ``piece_tokens`` tokens (a longer item is one piece)."""
    ids: list = []
    texts: list = []
    size = 0
    for r in pick(benchmark, item_id="item_id:bigint", text="text").where("length(text) > 0").toLocalIterator(prefetchPartitions=False):
        n = len(tk.plain_tokens(r.text))
        if ids and size + n > p.piece_tokens:
            yield _plain(ids, Items.of(texts, p.min_match))
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield _plain(ids, Items.of(texts, p.min_match))


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, tokens, doc_start, item_start): the longest match of every affected document and item."""
    rows = pick(docs, doc_id="doc_id:bigint", text="text")
    schema = "doc_id bigint, item_id bigint, tokens int, doc_start int, item_start int"
    sc, out = docs.sparkSession.sparkContext, None
    for piece in _pieces(benchmark, params):
        found = rows.mapInArrow(_searcher(sc.broadcast(piece), 1, params.shard_tokens, False), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that no benchmark item touches, with all their columns."""
    flat, text = positional(docs), place(docs, "text")
    sc, out = docs.sparkSession.sparkContext, flat
    for piece in _pieces(benchmark, params):
        out = out.mapInArrow(_searcher(sc.broadcast(piece), text, params.shard_tokens, True), flat.schema)
    return out.toDF(*docs.columns)
