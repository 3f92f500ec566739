"""Near-duplicate documents by HyperMinHash.

Every text's word shingles are hashed once.  The top bits of a hash name a
bucket; of the least remaining value in each bucket only its count of
leading zeros and its next mantissa bits are stored, in 16 bits.  Empty
buckets borrow a neighbour's register for banding (optimal densification),
so short texts band as well as long ones.  Texts that share a band are
compared by registers, where the share of equal registers is corrected for
collisions of compressed values; pairs that may reach the threshold are
verified by the exact Jaccard similarity of their shingle sets.

Texts with equal tokens are one node from the start.  Within a band's
bucket each text is first paired with the bucket's least id; then, once
components are known, with every text of the bucket that is still in
another component.  Pairs inside one component can't change the groups, so
leaving them out loses nothing, and a group of thousands costs thousands
of comparisons, not millions.  A bucket of many components is split by its
members' rarest shingles first, which loses no pair at the threshold.

The exact similarity is that of the sets of 64-bit shingle hashes.

Defined cases: NULL and empty texts (and texts without a token) are never
duplicates and stay; texts of fewer tokens than a shingle have one shingle,
the whole text; rows with a NULL doc_id stay; rows that repeat a doc_id
are one document, which keeps the row with the least text; of a group the
least doc_id stays; an empty table gives no duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import pick, place, positional, release, stored
from reelgrid.llm.components import grouped, joined, linked, rare_members, shared_buckets, torn

_U = np.uint64


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    log_buckets: int = 7
    mantissa: int = 10
    bands: int = 32
    threshold: float = 0.55
    #: Standard errors that an estimate may lie under the threshold and still be verified.
    slack: float = 3.0
    #: Pairs a member beyond which a bucket is split by rare shingles.
    spread: int = 64


def shingles(t: tk.Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every shingle, repeats included."""
    pos, doc = tk.windows_inside(t.offs, width)
    h = tk.window_hashes(t.hash, width)[pos] if len(pos) else np.zeros(0, dtype=_U)
    count = np.diff(t.offs)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        h = np.concatenate([h, tk.span_hashes(t.hash, t.offs[short], t.offs[short + 1])])
        doc = np.concatenate([doc, short])
    return h, doc


def registers(h: np.ndarray, doc: np.ndarray, n: int, p: Params) -> np.ndarray:
    """uint16 registers, ``n`` rows; 0 means an empty bucket.

    A value's rank is its leading zeros (capped at 47) and the mantissa
    bits after the first one bit.  Smaller hash, larger register.
    """
    m = 1 << p.log_buckets
    body = 64 - p.log_buckets
    drop = int(n - 1).bit_length()
    key = (doc.astype(_U) << _U(64 - drop)) | (h >> _U(drop)) if drop else h.copy()
    key.sort()
    cell = key >> _U(body - drop)
    first = np.ones(len(key), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    key, cell = key[first], cell[first]
    width = body - drop
    rest = key & _U((1 << width) - 1)
    zeros = width - np.frexp(np.maximum(rest, _U(1)).astype(np.float64))[1]
    zeros = np.minimum(np.maximum(zeros, 0), 47)
    mant = ((rest << (zeros + 1).astype(_U)) >> _U(width - p.mantissa)) & _U((1 << p.mantissa) - 1)
    out = np.zeros((n, m), dtype=np.uint16)
    out.reshape(-1)[cell.astype(np.int64)] = ((zeros + 1).astype(np.uint16) << np.uint16(p.mantissa)) | mant.astype(np.uint16)
    return out


def densified(reg: np.ndarray) -> np.ndarray:
    """Fills empty buckets from buckets that a fixed hash of (bucket, attempt) names."""
    out, m = reg.copy(), reg.shape[1]
    row, col = np.nonzero(reg == 0)
    alive = (reg != 0).any(axis=1)[row]
    row, col = row[alive], col[alive]
    attempt = 0
    while len(row):
        attempt += 1
        src = (tk.mix(col.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(m)).astype(np.int64)
        got = reg[row, src]
        out[row, col] = got
        left = got == 0
        row, col = row[left], col[left]
    return out


def band_keys(reg: np.ndarray, bands: int) -> np.ndarray:
    """One int64 key for each band of each row."""
    n, m = reg.shape
    parts = densified(reg).reshape(n, bands, m // bands).astype(_U)
    key = np.broadcast_to(np.arange(bands, dtype=_U)[None, :], (n, bands)).copy()
    for j in range(m // bands):
        key = tk.mix(key * _U(0x100000001B3) + parts[:, :, j] + _U(j))
    return key.view(np.int64)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows of sets of na and nb shingles, and its standard error."""
    m = 1 << p.log_buckets
    seen = (ra != 0) | (rb != 0)
    live = np.maximum(seen.sum(axis=1), 1)
    same = ((ra == rb) & seen).sum(axis=1) / live
    la, lb = na / m, nb / m
    both = la + lb
    clash = np.zeros(len(na))
    for z in range(48):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1)
        clash += 2.0 ** -(z + 1 + p.mantissa) * la * lb / both * (np.exp(-both * lo) - np.exp(-both * hi))
    clash = np.clip(clash / np.maximum(1 - np.exp(-both), 1e-9), 0, 0.5)
    j = np.clip((same - clash) / (1 - clash), 0.0, 1.0)
    return j, np.sqrt(np.maximum(j * (1 - j), 0.05) / live)


def _sketcher(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch, 1):
                t = tk.tokenize(b.column(1))
                some = np.flatnonzero(np.diff(t.offs) > 0)
                fp = [tk.span_hashes(t.hash, t.offs[some], t.offs[some + 1], s).view(np.int64) for s in (0, 0x5851F42D4C957F2D)]
                h, doc = shingles(t, p.shingle)
                size, reg = _distinct(h, doc, len(b)), registers(h, doc, len(b), p)
                regs = pa.array([r.tobytes() for r in reg[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *map(pa.array, fp), pa.array(size[some].astype(np.int32)), regs], ["doc_id", "f1", "f2", "n", "regs"])

    return run


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    bits = max(1, int(n - 1).bit_length())
    key = (doc.astype(_U) << _U(64 - bits)) | (h >> _U(bits))
    key.sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> _U(64 - bits)).astype(np.int64), minlength=n)


def _regs(col: pa.Array, p: Params) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(len(col), 1 << p.log_buckets)


def _bander(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                keys = band_keys(_regs(b.column(1), p), p.bands)
                ids = np.repeat(b.column(0).to_numpy(), p.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["bucket", "id"])

    return run


def _estimator(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                j, err = estimate(_regs(b.column(2), p), _regs(b.column(3), p), b.column(4).to_numpy().astype(float), b.column(5).to_numpy().astype(float), p)
                ok = pa.array(j + p.slack * err >= p.threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(j, 6))], ["a", "b", "estimate"]).filter(ok)

    return run


def _setter(p: Params):
    """Sorted distinct shingle hashes of a text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch, 1):
                h, doc = shingles(tk.tokenize(b.column(1)), p.shingle)
                by = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[by], np.arange(len(b) + 1))
                h = h[by]
                sets = [np.unique(h[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(b))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _verifier(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(len(b))
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                out[i] = common / max(1, len(both) - common)
            res = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(np.round(out, 6))], ["a", "b", "estimate", "jaccard"])
            yield res.filter(pa.array(out >= p.threshold))

    return run


def _lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of every set, one row each."""
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h), pa.array(np.full(len(h), len(h)))], ["id", "feature", "n"])


def shingle_sets(rows: DataFrame, need: DataFrame, p: Params) -> DataFrame:
    """(id, set) of the wanted documents.

    The join is a merge join at every size: the ids wanted grow with the
    corpus, so they are never broadcast.
    """
    wanted = rows.withColumnRenamed("doc_id", "id").join(need.hint("merge"), "id", "left_semi")
    return stored(wanted.groupBy("id").agg(F.min("text").alias("text")).mapInArrow(_setter(p), "id bigint, set binary"))


def verified(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) that reach the threshold, with estimate and exact similarity."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    near = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "ra", "rb", "na", "nb")
    near = near.mapInArrow(_estimator(p), "a bigint, b bigint, estimate double")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}"))
    got = near.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "sa", "sb", "estimate")
    return stored(got.mapInArrow(_verifier(p), "a bigint, b bigint, estimate double, jaccard double"))


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, group_id) of every document that has a duplicate; group_id is the least doc_id of the group."""
    p = params
    rows = pick(docs, doc_id="doc_id:bigint", text="text").where("doc_id is not null and text is not null")
    sketch = stored(rows.mapInArrow(_sketcher(p), "doc_id bigint, f1 bigint, f2 bigint, n int, regs binary"))
    least = [F.min("doc_id").alias("id"), F.max("doc_id").alias("top"), F.min("n").alias("n"), F.min("regs").alias("regs")]
    nodes = stored(sketch.groupBy("f1", "f2").agg(*least))
    member = joined(sketch, nodes)
    release(sketch)
    buckets = shared_buckets(nodes.select("id", "regs").mapInArrow(_bander(p), "bucket bigint, id bigint"))
    sets = shingle_sets(rows, buckets.select("id").distinct(), p)

    def refine(hot: DataFrame) -> DataFrame:
        need = sets.join(hot.select("id").distinct().hint("merge"), "id", "left_semi")
        return rare_members(hot, need.mapInArrow(_lister, "id bigint, feature bigint, n bigint"), p.threshold)

    roots = linked(buckets, lambda pairs: verified(nodes.select("id", "n", "regs"), sets, pairs, p), refine, torn(member), p.spread)
    return grouped(member, roots)


def duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, duplicate_of): documents to remove and the document of their group that stays."""
    return groups(docs, params).where("doc_id <> group_id").withColumnRenamed("group_id", "duplicate_of")


def drop_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents without near duplicates, with all their columns; one row a doc_id."""
    flat = positional(docs)
    key = F.col(f"_{place(docs, 'doc_id')}")
    gone = duplicates(docs, params).select(F.col("doc_id").alias("mark"), F.lit(True).alias("gone"))
    again = pick(docs, mark="doc_id:bigint").where("mark is not null").groupBy("mark").count().where("count > 1")
    marks = gone.join(again.hint("merge"), "mark", "full").select("mark", F.coalesce("gone", F.lit(False)).alias("gone"))
    kept = flat.join(marks.hint("merge"), key.cast("bigint") == F.col("mark"), "left").where("gone is null or not gone")
    order = [f"_{place(docs, 'text')}", *flat.columns]
    first = F.min_by(F.struct(*flat.columns), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\U0010ffff")) for c in order])).alias("row")
    once = kept.where("gone is null").select(*flat.columns)
    return once.union(kept.where("not gone").groupBy(key.cast("bigint")).agg(first).select("row.*")).toDF(*docs.columns)
