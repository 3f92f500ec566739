"""Suffix-array dedup by a distributed difference-cover algorithm.

Texts become strings of phrases: a text is cut where the hash of two
neighbouring tokens is least among ``window`` of them, so equal passages
are cut alike wherever they stand.  Phrases that occur once can't be part
of a repeat; what is left are runs of phrases that occur again and that
span at least ``least`` tokens.  Every passage of ``passage`` tokens that
occurs twice has such a run, since its cuts agree but for ``window`` tokens
at either border.  Equal runs are sorted once.

The runs' suffixes are sorted by difference cover modulo 3.  Suffixes at
places 1 and 2 modulo 3 are the sample: their triples are sorted and named
in order, and the strings of names are sorted by the same algorithm, until
no name occurs twice.  A suffix ends with its run, and so does a triple; equal
suffixes have equal ranks.  Of neighbouring names that occur once only the
first goes into the strings of names and ends a run there, since no
comparison looks past it; a rank is the name and, where it occurs again, the
rank among the strings of names.  The remaining suffixes,
place 0 modulo 3, are sorted by first symbol and next rank and merged in.
Then neighbours in the suffix array are compared: where their prefixes of
``least`` tokens agree, both are candidates.

The last comparison is of tokens: in the candidates' surroundings, which
hold every passage that occurs again, the prefix of ``passage`` tokens of
every token's suffix is compared by its hash, as in ``windows``.  So the
intervals are those of all windows of ``passage`` tokens that occur again,
with the same roles.

Between steps data travel as bytes: what one block (a run of rows of one
scan partition) sends to one bucket is one row, so sorting costs few rows
and little disk.  A block counts for itself first: of equal phrases, runs,
triples and prefixes only one travels, with a mark, so what a third of all
rows hold costs a bucket one entry a block.  Suffixes that need an order
are split by sampled suffixes, however alike their first symbols are.

The texts are read twice, and the second time each task takes its blocks'
surroundings from a table in the shared folder; so ``docs`` must give
the same rows in the same order when it is read again, as a table does.
Where it doesn't, an error is raised.

Defined cases: NULL and empty texts and texts of fewer than ``passage``
tokens have no repeat; repeated rows are repeats of each other, each row
for itself; rows with NULL doc_id are reported with NULL; a passage that
repeats within one text counts; very long texts are treated whole; an empty
table gives no intervals.  Phrases and prefixes are equal when their 64-bit
hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm import windows
from reelgrid.llm.base import pick, stored, written

_U = np.uint64


@dataclass(frozen=True)
class Params:
    window: int = 4
    #: Tokens of a passage.
    passage: int = 50
    #: Tokens of a block at a time, symbols and windows in a bucket.
    block_tokens: int = 1_000_000
    bucket_symbols: int = 1_000_000
    bucket_windows: int = 2_000_000

    @property
    def least(self) -> int:
        """Tokens that a passage's certain phrases span.

        The first cut that a window inside the passage makes lies within
        ``window`` tokens of its start, the last within ``window`` + 1 of
        its end; between them all cuts depend on the passage alone.
        """
        return self.passage - 2 * self.window


SENT = "bucket bigint, block bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, i binary"
BACK = "block bigint, kind int, bucket bigint, a binary, b binary, c binary"
TEXTS = "block bigint, n bigint, a binary, b binary, c binary, d binary, e binary, f binary"
STRING = "block bigint, n bigint, a binary, b binary"
REGIONS = "part bigint, block bigint, rows bigint, tokens bigint, windows bigint, a binary, b binary"
_SENT = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 9]
_BACK = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
_TEXTS = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
_STRING = [pa.int64(), pa.int64(), *[pa.binary()] * 2]
_REGIONS = [*[pa.int64()] * 5, *[pa.binary()] * 2]


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    wide = [r + (None,) * (len(types) - len(r)) for r in rows]
    cols = list(zip(*wide, strict=True)) if wide else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in names.split(", ")])


def _table(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, names, types)])


def _small(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, four each where they fit, else eight; a leading byte says which."""
    if len(x) and int(x.max()) >= 1 << 32:
        return b"8" + np.ascontiguousarray(x, dtype=np.int64).tobytes()
    return b"4" + np.ascontiguousarray(x, dtype=np.uint32).tobytes()


def _big(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64 if raw[:1] == b"8" else np.uint32, offset=1).astype(np.int64)


def _marks(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _number(n: int) -> bytes:
    return int(n).to_bytes(8, "big")


def _of(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    if not len(key):
        return []
    cuts = np.flatnonzero(np.diff(key)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True))


# Phrases


def cut_places(t: tk.Tokens, window: int) -> np.ndarray:
    """First tokens of the phrases."""
    n = len(t.hash)
    cut = np.zeros(n + 1, dtype=bool)
    cut[t.offs[:-1]] = True
    cut[n] = False
    m = n - window
    if m > 0:
        end = np.repeat(t.offs[1:], np.diff(t.offs))
        g = tk.mix(t.hash[:-1] * _U(0x9E3779B97F4A7C15) + t.hash[1:])
        best, arg = g[:m].copy(), np.zeros(m, dtype=np.int64)
        for o in range(1, window):
            x = g[o : o + m]
            less = x <= best
            best = np.where(less, x, best)
            arg[less] = o
        inside = np.flatnonzero(np.arange(m) + window < end[:m])
        cut[inside + arg[inside]] = True
    return np.flatnonzero(cut[:n])


class Blocks:
    """Cuts a partition's batches into blocks of about ``tokens`` tokens, alike whenever it is read."""

    def __init__(self, tokens: int):
        self.tokens = tokens

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, tk.Tokens, bool]]:
        """Block, rows, their tokens, and whether the block ends with them."""
        block, size, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            for s in tk.slices(batch, 1):
                if last is not None:
                    yield (*last, False)
                t = tk.tokenize(s.column(1))
                size += len(t.hash)
                last = (block, s, t)
                if size >= self.tokens:
                    yield (*last, True)
                    block, size, last = block + 1, 0, None
        if last is not None:
            yield (*last, True)


def _phrases(p: Params, buckets: int):
    """Sends each of a block's distinct phrases to its bucket, and once a block the rows' phrase counts, phrase lengths and which phrase stands where."""

    def pack(block: int, held: list) -> pa.RecordBatch:
        h, counts, size = (np.concatenate([x[k] for x in held]) for k in range(3))
        own, which, n = np.unique(h, return_inverse=True, return_counts=True)
        rows = [(block % buckets, block, 0, counts.astype(np.int64).tobytes(), size.astype(np.uint8).tobytes(), _small(which))]
        to = ((own >> _U(32)) * _U(buckets)) >> _U(32)
        for a, b in _runs(to):
            rows.append((int(to[a]), block, 1, _number(a), own[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()))
        return _batch(rows, SENT, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for block, _, t, last in Blocks(p.block_tokens).over(batches):
            start = cut_places(t, p.window)
            size = np.diff(start, append=len(t.hash))
            held.append((tk.span_hashes(t.hash, start, start + size), np.diff(np.searchsorted(start, t.offs)), size))
            if last:
                yield pack(block, held)
                held = []

    return run


def _repeated(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket of phrases: a number for each that occurs again."""
        kind, block, bucket = (t.column(c).to_numpy() for c in ("kind", "block", "bucket"))
        a, b, c = (t.column(x).to_pylist() for x in "abc")
        out = [(int(block[i]), 0, int(bucket[i]), a[i], b[i], c[i]) for i in np.flatnonzero(kind == 0)]
        rows = np.flatnonzero(kind == 1)
        if len(rows):
            hs = [np.frombuffer(b[i], dtype=_U) for i in rows]
            more = np.concatenate([_marks(c[i], len(x)) for i, x in zip(rows, hs, strict=True)])
            _, which, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
            again = n > 1
            again[which[more]] = True
            number = np.where(again, (np.cumsum(again) - 1) * buckets + int(bucket[0]), -1)[which]
            first = 0
            for i, x in zip(rows, hs, strict=True):
                own = number[first : first + len(x)]
                first += len(x)
                hit = np.flatnonzero(own >= 0)
                if len(hit):
                    out.append((int(block[i]), 1, int(bucket[i]), _small(_of(a[i]) + hit), _small(own[hit])))
        return _table(out, BACK, _BACK)

    return run


@dataclass
class Runs:
    """Runs of repeated phrases of one block that are long enough."""

    tokens: np.ndarray
    #: Of each phrase: its number, tokens, first token in the block, run.
    number: np.ndarray
    size: np.ndarray
    place: np.ndarray
    run: np.ndarray
    #: Of each run: first phrase, phrase after the last, hash.
    first: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, least: int) -> Runs:
        kind = t.column("kind").to_pylist()
        a, b, c = (t.column(x).to_pylist() for x in "abc")
        d = kind.index(0)
        counts, size, which = np.frombuffer(a[d], dtype=np.int64), np.frombuffer(b[d], dtype=np.uint8).astype(np.int64), _big(c[d])
        own = np.full(int(which.max()) + 1 if len(which) else 0, -1, dtype=np.int64)
        for i, k in enumerate(kind):
            if k == 1:
                own[_big(a[i])] = _big(b[i])
        number = own[which]
        doc = np.repeat(np.arange(len(counts)), counts)
        live = number >= 0
        new = live.copy()
        new[1:] &= ~live[:-1] | (doc[1:] != doc[:-1])
        run = np.cumsum(new) - 1
        ix = np.flatnonzero(live)
        spans = np.bincount(run[ix], weights=size[ix]) if len(ix) else np.zeros(0)
        ix = ix[spans[run[ix]] >= least]
        head = np.ones(len(ix), dtype=bool)
        head[1:] = np.diff(run[ix]) != 0
        first = np.flatnonzero(head)
        end = np.append(first[1:], len(ix)).astype(np.int64)
        tokens = np.bincount(doc, weights=size, minlength=len(counts)).astype(np.int64)
        h = tk.span_hashes(tk.mix(number[ix].astype(_U) + _U(1)), first, end) if len(ix) else np.zeros(0, dtype=_U)
        return cls(tokens, number[ix], size[ix], (np.cumsum(size) - size)[ix], np.cumsum(head) - 1, first, end, h)


def _send_runs(least: int, buckets: int):
    """One block: the hash of each of its distinct runs."""

    def run(t: pa.Table) -> pa.Table:
        block, r = int(t.column("block")[0].as_py()), Runs.of(t, least)
        own, first, n = np.unique(r.hash, return_index=True, return_counts=True)
        to = ((own >> _U(32)) * _U(buckets)) >> _U(32)
        rows = [(int(to[a]), block, 1, _small(first[a:b]), own[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in _runs(to)]
        return _table(rows, SENT, _SENT)

    return run


def _equal_runs(t: pa.Table) -> pa.Table:
    """One bucket of runs: 0 for a run that has no equal, 1 for the first of equal ones, 2 for the others."""
    block, bucket = t.column("block").to_numpy(), int(t.column("bucket")[0].as_py())
    rows = np.argsort(block, kind="stable")
    a, b, c = (t.column(x).to_pylist() for x in "abc")
    at = [a[i] for i in rows]
    hs = [np.frombuffer(b[i], dtype=_U) for i in rows]
    more = np.concatenate([_marks(c[i], len(x)) for i, x in zip(rows, hs, strict=True)])
    _, which, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    again = n > 1
    again[which[more]] = True
    by = np.argsort(which, kind="stable")
    first = np.zeros(len(which), dtype=bool)
    first[by[np.cumsum(n) - n]] = True
    code = np.where(first, again[which].astype(np.int64), 2)
    out, done = [], 0
    for i, x, h in zip(rows, at, hs, strict=True):
        out.append((int(block[i]), 3, bucket, x, code[done : done + len(h)].astype(np.uint8).tobytes()))
        done += len(h)
    return _table(out, BACK, _BACK)


def _strings(least: int):
    """One block: its runs, but for those with an earlier equal, as one padded string.

    a: symbols, from 2; 1 ends a run and 0 pads; b: fingerprint of each
    suffix's prefix; c: first token and span of the prefix; d: tokens of the
    rows; e: places of the runs that have an earlier equal; f: whether a
    symbol's run has later ones.
    """

    def run(t: pa.Table) -> pa.Table:
        kind, block = t.column("kind").to_pylist(), int(t.column("block")[0].as_py())
        r = Runs.of(t, least)
        if not len(r.number):
            return _table([], TEXTS, _TEXTS)
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        code = np.full(len(r.first), 2, dtype=np.int64)
        for i, k in enumerate(kind):
            if k == 3:
                code[_big(a[i])] = np.frombuffer(b[i], dtype=np.uint8)
        # the shortest prefix of each suffix that spans enough tokens within its run
        upto = np.concatenate([[0], np.cumsum(r.size)])
        last = np.searchsorted(upto, upto[:-1] + least)
        ok = last <= r.end[r.run]
        span = np.where(ok, upto[np.minimum(last, len(r.size))] - upto[:-1], 0)
        own = code[r.run] < 2
        gone = np.flatnonzero(~own & ok)
        ix = np.flatnonzero(own)
        head = np.ones(len(ix), dtype=bool)
        head[1:] = np.diff(r.run[ix]) != 0
        at = np.arange(len(ix)) + np.cumsum(head) - 1
        length = int(at[-1]) + 1 if len(ix) else 0
        full = length + 3 + (-(length + 3)) % 3
        sym, place, spans, copied = (np.zeros(full, dtype=np.int64) for _ in range(4))
        fp = np.zeros(full, dtype=_U)
        sym[:length] = 1
        sym[at] = r.number[ix] + 2
        place[at], spans[at], copied[at] = r.place[ix], span[ix], code[r.run[ix]]
        use = np.flatnonzero(own & ok)
        if len(use):
            fp[at[np.searchsorted(ix, use)]] = tk.span_hashes(tk.mix(r.number.astype(_U) + _U(1)), use, last[use]) | _U(1)
        e = np.concatenate([r.place[gone], span[gone]]).astype(np.uint32).tobytes()
        row = (block, full, _small(sym), fp.tobytes(), np.concatenate([place, spans]).astype(np.uint32).tobytes(), r.tokens.tobytes(), e, np.packbits(copied > 0).tobytes())
        return _table([row], TEXTS, _TEXTS)

    return run


# Sorting


def lex_bucket(cols: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at most each row, both compared column by column."""

    def before(mid: np.ndarray) -> np.ndarray:
        less, equal = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
        for x, s in zip(cols, splits, strict=True):
            v = s[mid]
            less |= equal & (x < v)
            equal &= v == x
        return less

    return _searched(len(cols[0]), len(splits[0]), before)


def _searched(n: int, k: int, before) -> np.ndarray:
    """For each of n rows the number of k ordered splitters that it isn't before."""
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, k, dtype=np.int64)
    for _ in range(int(k).bit_length()):
        mid = np.minimum((lo + hi) // 2, max(k - 1, 0))
        less, live = before(mid), lo < hi
        lo, hi = np.where(live & ~less, mid + 1, lo), np.where(live & less, mid, hi)
    return lo


@dataclass
class Suffixes:
    """Suffixes with what comparing any two of them needs.

    place: modulo 3; x, y: first symbols; p, p2: rank of the next suffix for
    places 0, else the own rank; q, q2: rank of the next for places 1, else
    of the one after.
    """

    place: np.ndarray
    x: np.ndarray
    y: np.ndarray
    p: np.ndarray
    q: np.ndarray
    p2: np.ndarray
    q2: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(*(c[at] for c in self.columns()))

    def before(self, other: Suffixes) -> np.ndarray:
        """Whether each suffix is less than the other's at the same index."""
        zero, zero_ = self.place == 0, other.place == 0
        with_x = zero | zero_
        with_y = (zero & (other.place == 2)) | (zero_ & (self.place == 2))
        less, equal = np.zeros(len(zero), dtype=bool), np.ones(len(zero), dtype=bool)
        by_q, by_q_ = with_y | (zero_ & (self.place == 1)), with_y | (zero & (other.place == 1))
        pairs = (
            (np.where(with_x, self.x, 0), np.where(with_x, other.x, 0)),
            (np.where(with_y, self.y, 0), np.where(with_y, other.y, 0)),
            (np.where(by_q, self.q, self.p), np.where(by_q_, other.q, other.p)),
            (np.where(by_q, self.q2, self.p2), np.where(by_q_, other.q2, other.p2)),
        )
        for a, b in pairs:
            less |= equal & (a < b)
            equal &= a == b
        return less

    def distinct(self) -> tuple[np.ndarray, Suffixes]:
        """Which different suffix each one is, and the different ones; suffixes of one place modulo 3 are equal when their ranks are."""
        x = np.where(self.place == 0, self.x, 0)
        by = np.lexsort((self.p2, self.p, x, self.place))
        new = np.ones(len(by), dtype=bool)
        if len(by) > 1:
            new[1:] = np.any([np.diff(c[by]) != 0 for c in (self.place, x, self.p, self.p2)], axis=0)
        which = np.empty(len(by), dtype=np.int64)
        which[by] = np.cumsum(new) - 1
        return which, self.take(by[new])

    def bucket(self, splits: Suffixes) -> np.ndarray:
        return _searched(len(self.x), len(splits.x), lambda mid: self.before(splits.take(mid)))

    def order(self) -> np.ndarray:
        zero, rest = np.flatnonzero(self.place == 0), np.flatnonzero(self.place)
        zero = zero[np.lexsort((self.p2[zero], self.p[zero], self.x[zero]))]
        rest = rest[np.lexsort((self.p2[rest], self.p[rest]))]
        among = self.take(rest)
        slot = self.take(zero).bucket(among) + np.arange(len(zero))
        order = np.empty(len(self.x), dtype=np.int64)
        taken = np.zeros(len(order), dtype=bool)
        taken[slot] = True
        order[slot] = zero
        order[~taken] = rest
        return order


def _next(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(len(x) - k, 0)] = x[k:]
    return out


def _following(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next two symbols of each place, 0 from the run's end on."""
    y, z = _next(s, 1)[at], _next(s, 2)[at]
    y = np.where(y > 1, y, 0)
    return y, np.where((y > 1) & (z > 1), z, 0)


def triples(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sample places that hold a symbol, which distinct triple each has, the triples in order, and which stand more than once."""
    at = np.flatnonzero((np.arange(len(s)) % 3 > 0) & (s > 1))
    x, y, z = s[at], *_following(s, at)
    by = np.lexsort((z, y, x))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (np.diff(x[by]) != 0) | (np.diff(y[by]) != 0) | (np.diff(z[by]) != 0)
    which = np.empty(len(by), dtype=np.int64)
    which[by] = np.cumsum(new) - 1
    head = by[new]
    return at, which, [x[head], y[head], z[head]], np.bincount(which, minlength=len(head)) > 1


def _sample(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(1).to_pylist():
                s = _big(raw)
                at = np.arange(step // 2 % max(len(s), 1), len(s), step)
                cols = [pa.array(_next(s, k)[at] if k else s[at]) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", "z"])

    return run


def _send_triples(splits: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, own, more = triples(_big(raw))
                to = lex_bucket(own, splits)
                for a, b in _runs(to):
                    rows.append((int(to[a]), block, 1, _number(a), *[_small(c[a:b]) for c in own], np.packbits(more[a:b]).tobytes()))
            yield _batch(rows, SENT, _SENT)

    return run


def _name(t: pa.Table) -> pa.Table:
    """One bucket of triples: each one's name, its place among the distinct ones from 2, and in the last bit whether nothing must be compared beyond it."""
    blocks, bucket = t.column("block").to_pylist(), int(t.column("bucket")[0].as_py())
    first = t.column("a").to_pylist()
    x, y, z = ([_big(r) for r in t.column(c).to_pylist()] for c in "bcd")
    sizes = list(map(len, x))
    more = np.concatenate([_marks(r, n) for r, n in zip(t.column("e").to_pylist(), sizes, strict=True)])
    x, y, z = map(np.concatenate, (x, y, z))
    by = np.lexsort((z, y, x))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (np.diff(x[by]) != 0) | (np.diff(y[by]) != 0) | (np.diff(z[by]) != 0)
    group = np.empty(len(by), dtype=np.int64)
    group[by] = np.cumsum(new) - 1
    n = int(new.sum())
    once = np.bincount(group, minlength=n) == 1
    once[group[more]] = False
    once[group[(y == 0) | (z == 0)]] = True
    name = (group + 2) * 2 + once[group]
    out: list = [(-1, 2, bucket, _number(n), _number(int(once.sum())))]
    done = 0
    for block, lo, k in zip(blocks, first, sizes, strict=True):
        out.append((int(block), 1, bucket, lo, _small(name[done : done + k])))
        done += k
    return _table(out, BACK, _BACK)


def _needed(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names the shorter string holds, those that occur again and what follows them, and their places there: names that occur once end a run."""
    again = (name > 0) & (name % 2 == 0)
    need = again.copy()
    need[1:] |= again[:-1]
    need &= name > 0
    end = ~again[need]
    follows = np.flatnonzero(need) + 1
    end |= np.append(name, 0)[follows] == 0
    return need, np.arange(len(end)) + np.cumsum(end) - end


def _name_strings(stride: int):
    """One block: names of places 1 modulo 3, three pads, names of places 2 modulo 3, pads (b); and what of them must be sorted (a)."""

    def run(t: pa.Table) -> pa.Table:
        block, kind, bucket = int(t.column("block")[0].as_py()), t.column("kind").to_pylist(), t.column("bucket").to_pylist()
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        s = _big(a[kind.index(0)])
        at, which, own, _ = triples(s)
        name = np.zeros(len(own[0]), dtype=np.int64)
        for i, k in enumerate(kind):
            if k == 1:
                x = _big(b[i])
                name[_of(a[i]) : _of(a[i]) + len(x)] = x + 2 * stride * bucket[i]
        half = len(s) // 3
        full = np.zeros(2 * half + 6, dtype=np.int64)
        full[np.where(at % 3 == 1, at // 3, half + 3 + at // 3)] = name[which]
        need, place = _needed(full)
        n = int(place[-1]) + 1 if len(place) else 0
        s = np.zeros(n + 3 + -n % 3, dtype=np.int64)
        s[:n] = 1
        s[place] = full[need] >> 1
        return _table([(block, len(s) if n else 0, _small(s), _small(full))], STRING, _STRING)

    return run


def _suffixes(t: pa.Table) -> tuple[int, np.ndarray, Suffixes]:
    """One block: places that hold a symbol and their suffixes; kind 0: symbols, 2: names, 1: ranks of the strings of names."""
    block, kind, a, b = int(t.column("block")[0].as_py()), t.column("kind").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist()
    s = _big(a[kind.index(0)])
    n = len(s)
    # a rank is the name, then the rank among the strings of names where the name occurs again
    full = _big(b[kind.index(2)])
    second = np.zeros(len(full), dtype=np.int64)
    if 1 in kind:
        need, place = _needed(full)
        second[need] = _big(a[kind.index(1)])[place]
    second[full % 2 == 1] = 0
    half = n // 3
    rank, rank2 = np.zeros((2, n + 3), dtype=np.int64)
    for r, x in ((rank, full >> 1), (rank2, second)):
        r[1:n:3], r[2:n:3] = x[:half], x[half + 3 : 2 * half + 3]
    at = np.flatnonzero(s > 1)
    one, two = np.where(at % 3 == 0, at + 1, at), np.where(at % 3 == 1, at + 1, at + 2)
    y, _ = _following(s, at)
    two[(at % 3 != 1) & (y == 0)] = n  # past a run's end
    return block, at, Suffixes(at % 3, s[at], y, rank[one], rank[two], rank2[one], rank2[two])


def _sample_suffixes(step: int):
    def run(t: pa.Table) -> pa.Table:
        _, at, own = _suffixes(t)
        own = own.take(np.arange(step // 2 % max(len(at), 1), len(at), step))
        return pa.table({f"c{i}": c for i, c in enumerate(own.columns())})

    return run


def _rows_of(block: int, to: np.ndarray, own: list) -> list[tuple]:
    by = np.argsort(to, kind="stable")
    return [(int(to[by[a]]), block, 1, *[f(c[by[a:b]]) for f, c in own]) for a, b in _runs(to[by])]


def _send_suffixes(splits: Suffixes, buckets: int):
    """One block: each different suffix, to the bucket of the splitting suffixes around it; and once which of them stands where."""

    def run(t: pa.Table) -> pa.Table:
        block, at, own = _suffixes(t)
        which, own = own.distinct()
        to = own.bucket(splits)
        by = np.argsort(to, kind="stable")
        back = np.empty(len(by), dtype=np.int64)
        back[by] = np.arange(len(by))
        to, own = to[by], own.take(by)
        rows = [(block % buckets, block, 0, _small(at), _small(back[which]))]
        for a, b in _runs(to):
            rows.append((int(to[a]), block, 1, _number(a), *[_small(c[a:b]) for c in own.columns()]))
        return _table(rows, SENT, _SENT)

    return run


def _send_prefixes(splits: list[np.ndarray]):
    """One block: of the suffixes with one prefix the first, to the bucket of its first symbols; with the prefix and whether it has more."""

    def run(t: pa.Table) -> pa.Table:
        block, at, own = _suffixes(t)
        i = t.column("kind").to_pylist().index(0)
        s, fp = _big(t.column("a")[i].as_py()), np.frombuffer(t.column("b")[i].as_py(), dtype=np.int64)[at]
        copied = _marks(t.column("f")[i].as_py(), len(s))[at]
        live = np.flatnonzero(fp)  # shorter suffixes can't be repeats
        prefix, first, which, n = np.unique(fp[live], return_index=True, return_inverse=True, return_counts=True)
        more = n > 1
        more[which[copied[live]]] = True
        keep = live[first]
        own = own.take(keep)
        to = lex_bucket([own.x, own.y, _following(s, at[keep])[1]], splits)
        cols = [(_small, c) for c in own.columns()]
        return _table(_rows_of(block, to, [*cols, (np.ndarray.tobytes, prefix), (lambda m: np.packbits(m).tobytes(), more)]), SENT, _SENT)

    return run


def _received(t: pa.Table, names: str) -> tuple[list[int], list[int], list[np.ndarray]]:
    cols = [[_big(r) for r in t.column(c).to_pylist()] for c in names]
    return t.column("block").to_pylist(), list(map(len, cols[0])), list(map(np.concatenate, cols))


def _rank_bucket(t: pa.Table) -> pa.Table:
    bucket, kind = int(t.column("bucket")[0].as_py()), t.column("kind").to_numpy()
    where = t.filter(pa.array(kind == 0))
    out: list = [(b, 0, bucket, x, y) for b, x, y in zip(*(where.column(c).to_pylist() for c in ("block", "a", "b")), strict=True)]
    t = t.filter(pa.array(kind == 1))
    if len(t):
        blocks, sizes, cols = _received(t, "bcdefgh")
        own = Suffixes(*cols)
        order = own.order()
        new = np.ones(len(order), dtype=bool)
        new[1:] = own.take(order[:-1]).before(own.take(order[1:]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new)
        out.append((-1, 2, bucket, _number(len(order) + 1), _number(0)))
        done = 0
        for block, lo, n in zip(blocks, t.column("a").to_pylist(), sizes, strict=True):
            out.append((int(block), 1, bucket, lo, _small(rank[done : done + n])))
            done += n
    return _table(out, BACK, _BACK)


def _gather_ranks(stride: int):
    def run(t: pa.Table) -> pa.Table:
        block, kind, bucket = int(t.column("block")[0].as_py()), t.column("kind").to_pylist(), t.column("bucket").to_pylist()
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        at, which = _big(a[kind.index(0)]), _big(b[kind.index(0)])
        own = np.zeros(int(which.max()) + 1, dtype=np.int64)
        for i, k in enumerate(kind):
            if k == 1:
                x = _big(b[i])
                own[_of(a[i]) : _of(a[i]) + len(x)] = x + stride * bucket[i]
        rank = np.zeros(int(at.max()) + 4, dtype=np.int64)
        rank[at] = own[which]
        return _table([(block, len(rank), _small(rank))], STRING, _STRING)

    return run


def _compare_neighbours(t: pa.Table) -> pa.Table:
    """One bucket of the suffix array: the prefixes that a neighbour has as well, or that their own block has again."""
    blocks, sizes, cols = _received(t, "abcdefg")
    bucket, order = int(t.column("bucket")[0].as_py()), Suffixes(*cols).order()
    fp = np.concatenate([np.frombuffer(r, dtype=np.int64) for r in t.column("h").to_pylist()])
    more = np.concatenate([_marks(r, n) for r, n in zip(t.column("i").to_pylist(), sizes, strict=True)])
    f = fp[order]
    same = f[1:] == f[:-1]
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    out, done = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        hit = fp[done : done + n][more[done : done + n]]
        done += n
        if len(hit):
            out.append((int(block), 1, bucket, hit.tobytes()))
    return _table(out, BACK, _BACK)


def _stats(back: DataFrame) -> tuple[int, bool]:
    """One more than the most that a bucket holds, so that bucket times this is a start for its numbers; and whether any name needs more."""
    count, low = (F.conv(F.hex(c), 16, 10).cast("bigint") for c in ("a", "b"))
    most, all_, once = back.where("kind = 2").agg(F.max(count), F.sum(count), F.sum(low)).first()
    return (most or 0) + 1, (once or 0) < (all_ or 0)


def _splitters(strings: DataFrame, n: int, p: Params) -> list[np.ndarray]:
    """Sampled triples that cut the suffixes into about equal buckets."""
    k = max(1, -(-n // p.bucket_symbols))
    got = strings.select("block", "a").mapInArrow(_sample(max(1, n // (k * 200))), "x bigint, y bigint, z bigint").toArrow()
    x, y, z = (got.column(c).to_numpy() for c in "xyz")
    by = np.lexsort((z, y, x))
    at = by[np.unique(np.linspace(0, len(by) - 1, k + 1).astype(np.int64)[1:-1])] if len(by) else by
    return [x[at], y[at], z[at]]


def _ranked(strings: DataFrame, p: Params, splits: list[np.ndarray]) -> DataFrame:
    """Symbols, names and ranks of all blocks, to be grouped by block; see ``_suffixes``."""
    sent = strings.select("block", "a").mapInArrow(_send_triples(splits), SENT)
    named = stored(sent.groupBy("bucket").applyInArrow(_name, BACK))
    stride, deeper = _stats(named)
    none = F.lit(None).cast("binary")
    head = strings.select("block", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("bucket"), "a", none.alias("b"))
    short = stored(head.union(named.where("kind = 1").select("block", "kind", "bucket", "a", "b")).groupBy("block").applyInArrow(_name_strings(stride), STRING))
    own = strings.select("block", F.lit(0).alias("kind"), "a", *(("b", "f") if "f" in strings.columns else (none.alias("b"), none.alias("f"))))
    both = own.union(short.select("block", F.lit(2).alias("kind"), none, "b", none))
    if deeper:
        both = both.union(ranks(short.where("n > 0").select("block", "n", "a"), p).select("block", F.lit(1).alias("kind"), "a", none, none))
    return both


def _length(strings: DataFrame) -> int:
    return strings.agg(F.sum("n")).first()[0] or 0


def ranks(strings: DataFrame, p: Params) -> DataFrame:
    """(block, a): the rank of every suffix of every block's string."""
    n = _length(strings)
    both = _ranked(strings, p, _splitters(strings, n, p))
    k = max(1, -(-n // p.bucket_symbols))
    if k > 1:
        got = both.groupBy("block").applyInArrow(_sample_suffixes(max(1, n // (k * 200))), ", ".join(f"c{i} bigint" for i in range(7))).toArrow()
        some = Suffixes(*(c.to_numpy() for c in got.columns))
        by = some.order()
        splits = some.take(by[np.unique(np.linspace(0, len(by) - 1, k + 1).astype(np.int64)[1:-1])])
    else:
        splits = Suffixes(*[np.zeros(0, dtype=np.int64)] * 7)
    merged = stored(both.groupBy("block").applyInArrow(_send_suffixes(splits, k), SENT).groupBy("bucket").applyInArrow(_rank_bucket, BACK))
    stride, _ = _stats(merged)
    return stored(merged.where("kind < 2").groupBy("block").applyInArrow(_gather_ranks(stride), STRING))


# Surroundings of candidates, and the last comparison


def _regions(p: Params):
    """One block: token intervals around its candidates that may hold a passage."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_pylist()
        a, b, c, d, e = (t.column(x).to_pylist() for x in "abcde")
        i = kind.index(0)
        block = int(t.column("block")[0].as_py())
        place, span = np.frombuffer(c[i], dtype=np.uint32).astype(np.int64).reshape(2, -1)
        tokens, fp = np.frombuffer(d[i], dtype=np.int64), np.frombuffer(b[i], dtype=np.int64)
        gone_place, gone_span = np.frombuffer(e[i], dtype=np.uint32).astype(np.int64).reshape(2, -1)
        hits = [np.frombuffer(a[k], dtype=np.int64) for k, v in enumerate(kind) if v == 1]
        x = np.flatnonzero(np.isin(fp, np.concatenate(hits))) if hits else np.zeros(0, dtype=np.int64)
        start = np.concatenate([place[x], gone_place])
        stop = np.concatenate([place[x] + span[x], gone_place + gone_span])
        ends = np.cumsum(tokens)
        row = np.searchsorted(ends, start, side="right")
        start, stop = np.maximum(start - 2 * p.window, (ends - tokens)[row]), np.minimum(stop + 2 * p.window, ends[row])
        ok = stop - start >= p.passage
        row, start, stop = row[ok], start[ok], stop[ok]
        if not len(start):
            return _table([], REGIONS, _REGIONS)
        by = np.argsort(start, kind="stable")
        row, start, stop = row[by], start[by], stop[by]
        most = np.maximum.accumulate(stop)
        new = np.ones(len(by), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > most[:-1])
        head = np.flatnonzero(new)
        begin, stop = start[head], most[np.append(head[1:], len(by)) - 1]
        count = int((stop - begin - p.passage + 1).sum())
        return _table([(block >> 32, block, len(tokens), int(tokens.sum()), count, _small(begin), _small(stop))], REGIONS, _REGIONS)

    return run


def _read(path: str, part: int) -> dict[int, tuple]:
    """The regions of one partition's blocks, by block."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    files, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://")) if "://" in path else (fs.LocalFileSystem(), path)
    out: dict[int, tuple] = {}
    found = files.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    for f in found:
        if f.path.endswith(".parquet"):
            t = parquet.read_table(f.path, filesystem=files, partitioning=None)
            for r in t.select(["block", "rows", "tokens", "a", "b"]).to_pylist():
                out[r["block"]] = (r["rows"], r["tokens"], _big(r["a"]), _big(r["b"]))
    return out


def _picker(p: Params, path: str, buckets: int):
    """Windows inside the regions, packed as ``windows`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = _read(path, TaskContext.get().partitionId())
        held, rows, tokens = [], 0, 0
        for block, s, t, last in Blocks(p.block_tokens).over(batches):
            n = len(t.hash)
            if block in regions:
                _, _, begin, stop = regions[block]
                mine = slice(np.searchsorted(begin, tokens), np.searchsorted(begin, tokens + n))
                begin, count = begin[mine], stop[mine] - begin[mine] - p.passage + 1
                at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
                h = tk.window_hashes(t.hash, p.passage)[at - tokens] if len(at) else np.zeros(0, dtype=_U)
                held.append((h, at, *windows.placed(s.column(0), np.diff(t.offs))))
            rows, tokens = rows + len(s), tokens + n
            if last:
                if block in regions and regions[block][:2] != (rows, tokens):
                    raise RuntimeError("the documents changed between two readings; give a stored table")
                if held:
                    yield windows.pack(buckets, block, held)
                held, rows, tokens = [], 0, 0

    return run


def intervals(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, start_token, end_token, role): maximal intervals of repeated text."""
    p = params
    rows = pick(docs, doc_id="doc_id:bigint", text="text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (12 * p.bucket_symbols)))
    numbered = stored(rows.mapInArrow(_phrases(p, buckets), SENT).groupBy("bucket").applyInArrow(_repeated(buckets), BACK))
    runs = numbered.groupBy("block").applyInArrow(_send_runs(p.least, buckets), SENT).groupBy("bucket").applyInArrow(_equal_runs, BACK)
    strings = stored(numbered.union(runs).groupBy("block").applyInArrow(_strings(p.least), TEXTS))
    n = _length(strings)
    if not n:
        return docs.sparkSession.createDataFrame([], windows.FOUND)
    splits = _splitters(strings, n, p)
    array = _ranked(strings, p, splits).groupBy("block").applyInArrow(_send_prefixes(splits), SENT).groupBy("bucket").applyInArrow(_compare_neighbours, BACK)
    none = F.lit(None).cast("binary")
    where = strings.select("block", F.lit(0).alias("kind"), none.alias("a"), "b", "c", "d", "e")
    around = where.union(array.select("block", "kind", "a", none, none, none, none)).groupBy("block").applyInArrow(_regions(p), REGIONS)
    path = written(around.repartition("part"), "part")
    count = docs.sparkSession.read.schema(REGIONS).parquet(path).agg(F.sum("windows")).first()[0] or 0
    packed = rows.mapInArrow(_picker(p, path, max(1, -(-count // p.bucket_windows))), windows.PACKED)
    return packed.groupBy("bucket").applyInArrow(windows.count_bucket, windows.ROUTED).groupBy("block").applyInArrow(windows.merger(p.passage), windows.FOUND)
