"""Substring dedup by Rabin-Karp hashes of every window of ``width`` tokens.

Every window of every text is hashed.  A block (a run of rows of one scan
partition) first counts for itself: of a hash's windows only the first
travels, with a mark where the block has more, so a window that a third of
all rows hold costs one entry a block, not one a row.  Windows travel to
the hash's bucket packed as bytes: what one block sends to one bucket is one
row.  Each bucket counts its hashes; the repeated ones go back to their
blocks, where windows that neighbour merge into maximal token intervals.

The first window of a hash in scan order has the role 'keep', all others
'remove'; intervals of each role merge for themselves, so that cutting the
'remove' intervals leaves one copy of every passage.  A block's windows
after its first of a hash are 'remove' whatever the other blocks hold.

Blocks and buckets grow together with the corpus, as the square root of its
windows, so that a row holds ``row_windows`` windows or more, up to
``most_windows``, which bounds the memory of a task.

Defined cases: NULL and empty texts and texts of fewer than ``width``
tokens have no window; rows that repeat a document repeat its windows, each
row for itself; rows with NULL doc_id are reported with NULL; an empty
table gives no intervals.  A passage that repeats within one text counts;
very long texts are treated whole.  Windows are equal when their 64-bit
hashes are; they aren't compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import textkernel as tk
from reelgrid.llm.base import pick

_U = np.uint64


@dataclass(frozen=True)
class Params:
    width: int = 50
    #: Windows of a block, what one task packs at a time, and of a bucket, at least.
    block_windows: int = 1_000_000
    bucket_windows: int = 2_000_000
    row_windows: int = 256
    most_windows: int = 8_000_000

    def sizes(self, windows: int) -> tuple[int, int]:
        """Windows of a block, and the number of buckets, for so many windows in all."""
        even = min(self.most_windows, isqrt(self.row_windows * windows))
        return max(self.block_windows, even), max(1, -(-windows // max(self.bucket_windows, even)))


PACKED = "bucket int, block bigint, kind int, a binary, b binary"
ROUTED = "block bigint, kind int, a binary, b binary"
FOUND = "doc_id bigint, start_token int, end_token int, role string"
_KIND_DOCS, _KIND_WINDOWS, _KIND_CODES = 0, 1, 2


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each hash's first window, whether it has more, and the places of those."""
    by = np.argsort(h, kind="stable")
    s = h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    more = np.zeros(len(h), dtype=bool)
    more[:-1] = ~new[1:]
    mark = np.zeros(len(h), dtype=np.int8)
    mark[by] = new.astype(np.int8) + (new & more)
    first = np.flatnonzero(mark)
    return first, mark[first] == 2, np.flatnonzero(mark == 0)


def pack(buckets: int, block: int, held: list) -> pa.RecordBatch:
    """One block; held: hashes of windows, their places, ids, and places of each row (see ``placed``)."""
    h, at, ids, counts = (np.concatenate([x[k] for x in held]) for k in range(4))
    first, more, rest = firsts(h)
    rows = [(block % buckets, block, _KIND_DOCS, ids.tobytes(), counts.astype(np.int64).tobytes())]
    if len(rest):
        rows.append((block % buckets, block, _KIND_CODES, (at[rest] * 2 + 1).astype(np.int64).tobytes(), b""))
    h, at = h[first], at[first] * 2 + more
    b = (h % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    by = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[by])) + 1
    for part in np.split(by, cuts) if len(by) else []:
        step = np.diff(at[part], prepend=0)
        small = step.max() < 1 << 16
        rows.append((int(b[part[0]]), block, _KIND_WINDOWS, h[part].tobytes(), step.astype(np.uint16 if small else np.uint32).tobytes()))
    return _rows(rows, ["bucket", "block", "kind", "a", "b"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def placed(ids: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the number of places of each row; rows with a NULL id have negative numbers."""
    return ids.fill_null(0).to_numpy(), np.where(ids.is_null().to_numpy(zero_copy_only=False), -1 - counts, counts)


def _packer(p: Params, block_windows: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for s in tk.slices(batch, 1):
                t = tk.tokenize(s.column(1))
                pos, _ = tk.windows_inside(t.offs, p.width)
                if not len(pos):
                    continue
                at = np.arange(size, size + len(pos))
                held.append((tk.window_hashes(t.hash, p.width)[pos], at, *placed(s.column(0), np.maximum(np.diff(t.offs) - p.width + 1, 0))))
                size += len(pos)
                if size >= block_windows:
                    yield pack(buckets, block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield pack(buckets, block, held)

    return run


def count_bucket(t: pa.Table) -> pa.Table:
    """One bucket: its windows whose hash occurs again, by block, with the role in the last bit."""
    types, names = [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["block", "kind", "a", "b"]
    kind, block = t.column("kind").to_numpy(), t.column("block").to_numpy()
    a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
    out = [(int(block[i]), int(kind[i]), a[i], b[i]) for i in np.flatnonzero(kind != _KIND_WINDOWS)]
    rows = [i for i in np.argsort(block, kind="stable") if kind[i] == _KIND_WINDOWS]
    if rows:
        hs = [np.frombuffer(a[i], dtype=_U) for i in rows]
        at = [np.cumsum(np.frombuffer(b[i], dtype=np.uint16 if len(b[i]) == len(a[i]) // 4 else np.uint32), dtype=np.int64) for i in rows]
        h = np.concatenate(hs)
        own = np.concatenate(at) % 2 == 1
        by = np.argsort(h, kind="stable")
        hs_ = h[by]
        new = np.ones(len(h), dtype=bool)
        new[1:] = hs_[1:] != hs_[:-1]
        again = ~new
        many = own[by]
        many[:-1] |= again[1:]
        code = np.zeros(len(h), dtype=np.int8)
        code[by[many & new]] = 1
        code[by[again]] = 2
        first = 0
        for i, x, place in zip(rows, hs, at, strict=True):
            c = code[first : first + len(x)]
            first += len(x)
            hit = np.flatnonzero(c)
            if len(hit):
                out.append((int(block[i]), _KIND_CODES, ((place[hit] >> 1) * 2 + (c[hit] - 1)).astype(np.int64).tobytes(), b""))
    return pa.Table.from_batches([_rows(out, names, types)])


def merger(width: int):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        d = int(np.flatnonzero(kind == _KIND_DOCS)[0])
        ids, counts = np.frombuffer(a[d], dtype=np.int64), np.frombuffer(b[d], dtype=np.int64)
        unknown = counts < 0
        counts = np.where(unknown, -1 - counts, counts)
        codes = [np.frombuffer(a[i], dtype=np.int64) for i in np.flatnonzero(kind == _KIND_CODES)]
        codes = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        first = np.cumsum(counts) - counts
        parts = []
        for role in (0, 1):
            at = np.sort(codes[(codes & 1) == role] >> 1)
            if not len(at):
                continue
            doc = np.searchsorted(first + counts, at, side="right")
            new = np.ones(len(at), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) > width)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            base = first[doc[begin]]
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids[doc[begin]], pa.int64(), mask=unknown[doc[begin]]),
                        "start_token": pa.array((at[begin] - base).astype(np.int32)),
                        "end_token": pa.array((at[end] - base + width).astype(np.int32)),
                        "role": pa.array(["keep", "remove"][role : role + 1] * len(begin)),
                    }
                )
            )
        none = pa.schema([("doc_id", pa.int64()), ("start_token", pa.int32()), ("end_token", pa.int32()), ("role", pa.string())])
        return pa.concat_tables(parts) if parts else none.empty_table()

    return run


def intervals(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, start_token, end_token, role): maximal intervals of repeated windows."""
    p = params
    rows = pick(docs, doc_id="doc_id:bigint", text="text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_windows, buckets = p.sizes(size // 6)
    packed = rows.mapInArrow(_packer(p, block_windows, buckets), PACKED)
    routed = packed.groupBy("bucket").applyInArrow(count_bucket, ROUTED)
    return routed.groupBy("block").applyInArrow(merger(p.width), FOUND)
