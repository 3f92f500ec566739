"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) with the next ``chain`` content
words after it; a document is the set of its signatures.  Sets are
partitioned by length: two sets whose lengths differ by more than the
threshold's factor can't be similar, so a set meets only its own partition
and, near the upper border, the next one.  Within a partition an inverted
index holds each set's rarest signatures, just so many that two similar
sets must share one (prefix pruning); candidates of too different length
or bitmaps are pruned, the rest compared by exact Jaccard.

A prefix bucket that still has many unlinked members is split by the rarest
signatures among its own members, which loses no pair at the threshold.

Rarity comes from a table of document counts of fixed size
(``2**slot_bits`` counters by hash), summed over all documents; any order
would be right, a rare-first order is fast.  Sets that are equal are one
node from the start.

Defined cases: NULL and empty texts and texts without a signature have no
fingerprint and no duplicate; rows with NULL doc_id are left out; rows that
repeat a doc_id add nothing when equal, and are one document else; the
least doc_id of a group stands for it; an empty table gives no rows; very
long texts are treated whole; signatures are compared by 48-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import bucketed, pick, release, stored
from reelgrid.llm.components import grouped, joined, linked, rare_members, shared_buckets, torn

_U = np.uint64

ANCHORS = "the a is was that le la les est un une der die das ist ein el los es una".split()
COMMON = (
    "the of and to a in is that it for was on with as be by this are at from or an not have he she they we you "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au il elle ne se ce "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an "
    "el y los del las por con no su para es al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Params:
    chain: int = 2
    threshold: float = 0.55
    slot_bits: int = 18
    #: Pairs a member beyond which a bucket is split by rare signatures.
    spread: int = 64
    anchors: tuple[str, ...] = tuple(ANCHORS)
    common: tuple[str, ...] = tuple(dict.fromkeys(COMMON))


#: The bitmap's columns.
WORDS = ["w0", "w1", "w2", "w3"]


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(tk.tokenize(pa.array(list(words))).hash)


def _member(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return words[at] == h


def signatures(col: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures (48 bits) and their text's index, sorted by both."""
    t = tk.tokenize(col)
    anchor = np.flatnonzero(_member(t.hash, _hashes(p.anchors)))
    content = np.flatnonzero(~_member(t.hash, _hashes(p.common)))
    at = np.searchsorted(content, anchor, side="right")
    end = np.repeat(t.offs[1:], np.diff(t.offs))
    ok = at + p.chain <= len(content)
    anchor, at = anchor[ok], at[ok]
    last = content[at + p.chain - 1] if len(at) else at
    ok = last < end[anchor]
    anchor, at = anchor[ok], at[ok]
    key = t.hash[anchor].copy()
    for j in range(p.chain):
        key = tk.mix(key * _U(0x9E3779B97F4A7C15) + t.hash[content[at + j]] + _U(j))
    doc = np.searchsorted(t.offs, anchor, side="right") - 1
    both = np.unique((doc.astype(_U) << _U(48)) | (key >> _U(16)))
    return both & _U((1 << 48) - 1), (both >> _U(48)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 1 << 14):
            yield from tk.slices(batch.slice(i, 1 << 14), 1)


def _slot(sig: np.ndarray, bits: int) -> np.ndarray:
    return (sig & _U((1 << bits) - 1)).astype(np.int64)


def _slot_counts(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << p.slot_bits, dtype=np.int64)
        for b in _pieces(batches):
            total += np.bincount(_slot(signatures(b.column(1), p)[0], p.slot_bits), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    return run


def pack(sig: np.ndarray) -> bytes:
    return np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def bitmaps(sig: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """256 bits of each set, in four words; each signature sets one bit."""
    at = (tk.mix(sig) >> _U(56)).astype(np.int64)
    out = np.zeros(4 * n, dtype=_U)
    np.bitwise_or.at(out, doc * 4 + (at >> 6), _U(1) << (at & 63).astype(_U))
    return out.view(np.int64).reshape(n, 4)


def _printer(p: Params, shared):
    """Sets in rare-first order, with two order-free sums that name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in _pieces(batches):
            sig, doc = signatures(b.column(1), p)
            by = np.lexsort((sig, counts[_slot(sig, p.slot_bits)], doc))
            sig = sig[by]
            cuts = np.searchsorted(doc, np.arange(len(b) + 1))
            some = np.flatnonzero(np.diff(cuts))
            sums = []
            for salt in (1, 2):
                run_ = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(tk.mix(sig * _U(2) + _U(salt)), dtype=_U)])
                sums.append((run_[cuts[some + 1]] - run_[cuts[some]]).view(np.int64))
            sets = pa.array([pack(sig[cuts[i] : cuts[i + 1]]) for i in some], pa.binary())
            bits = bitmaps(sig, doc, len(b))[some].T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *map(pa.array, sums), sets, *map(pa.array, bits)], ["doc_id", "f1", "f2", "sigs", *WORDS])

    return run


def edges_of_partitions(threshold: float, top: int = 1 << 40) -> np.ndarray:
    """First length of each partition; a partition spans three times the threshold's factor."""
    out, x = [1], 1.0
    while out[-1] < top:
        x = max(x / threshold**3, out[-1] + 1)
        out.append(int(np.ceil(x)))
    return np.array(out)


def _lister(p: Params):
    """(part, sig, id) of every set's prefix, in its own partition and as a guest of the next where it can match there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = edges_of_partitions(p.threshold)
        for b in batches:
            parts, sigs, ids = [], [], []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(raw) // 6
                prefix = unpack(raw[: 6 * (n - int(np.ceil(p.threshold * n - 1e-9)) + 1)])
                home = int(np.searchsorted(edges, n, side="right")) - 1
                for k in (home, home + 1) if n >= p.threshold * edges[home + 1] - 1e-9 else (home,):
                    sigs.append(prefix)
                    parts.append(np.full(len(prefix), k, dtype=np.int32))
                    ids.append(np.full(len(prefix), doc_id, dtype=np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(ids))], ["part", "sig", "id"])

    return run


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signatures of every set, one row each."""
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = unpack(raw).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h), pa.array(np.full(len(h), len(h)))], ["id", "feature", "n"])


def _comparer(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(len(b), dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                both = np.concatenate([unpack(x), unpack(y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = common >= p.threshold * (len(both) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, group_id) of every document that has a similar one."""
    p = params
    rows = pick(docs, doc_id="doc_id:bigint", text="text").where("doc_id is not null and text is not null")
    counts = np.zeros(1 << p.slot_bits, dtype=np.int64)
    slots = rows.mapInArrow(_slot_counts(p), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    prints = stored(rows.mapInArrow(_printer(p, shared), f"doc_id bigint, f1 bigint, f2 bigint, sigs binary, {', '.join(f'{w} bigint' for w in WORDS)}"))
    least = [F.min("doc_id").alias("id"), F.max("doc_id").alias("top"), *[F.first(c).alias(c) for c in ("sigs", *WORDS)]]
    nodes = stored(prints.groupBy("f1", "f2").agg(*least))
    member = joined(prints, nodes)
    release(prints)
    listed = nodes.select("id", "sigs").mapInArrow(_lister(p), "part int, sig bigint, id bigint")
    buckets = shared_buckets(listed.select((F.shiftleft(F.col("part").cast("bigint"), 48) + F.col("sig")).alias("bucket"), "id"))
    known = bucketed(nodes.select("id", "sigs", *WORDS).join(buckets.select("id").distinct().hint("merge"), "id", "left_semi"), "id", nodes.count())
    release(nodes)
    length = (F.length("sigs") / 6).cast("int")
    tau = p.threshold

    def verify(pairs: DataFrame) -> DataFrame:
        """Pruning by length, by bitmaps (sets differ at least in as many signatures as their bitmaps do in bits) and, where
        ``met`` is counted, by overlap: two sets share at most the shared prefix signatures (``met``) and one set's remainder."""
        for c in "ab":
            pairs = pairs.join(known.select(F.col("id").alias(c), length.alias(f"n{c}"), *[F.col(w).alias(w + c) for w in WORDS]).hint("merge"), c)
        both = F.col("na") + F.col("nb")
        near = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(tau) - 1e-6
        alike = sum(F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in WORDS) <= both * F.lit((1 - tau) / (1 + tau)) + 1e-6
        enough = F.col("met") >= both * F.lit(tau / (1 + tau)) - F.ceil(F.greatest("na", "nb") * F.lit(tau) - 1e-9) + 1 - 1e-6
        pairs = pairs.where(near & alike & (F.col("met").isNull() | enough)).select("a", "b")
        for c in "ab":
            pairs = pairs.join(known.select(F.col("id").alias(c), F.col("sigs").alias(f"s{c}")).hint("merge"), c)
        return stored(pairs.select("a", "b", "sa", "sb").mapInArrow(_comparer(p), "a bigint, b bigint"))

    def refine(hot: DataFrame) -> DataFrame:
        need = known.join(hot.select("id").distinct().hint("merge"), "id", "left_semi")
        return rare_members(hot, need.mapInArrow(_featurer, "id bigint, feature bigint, n bigint"), tau)

    return grouped(member, linked(buckets, verify, refine, torn(member), p.spread))
