"""Sharding by minimax contiguous partition.

Rows with one doc_id (epochs of a document) are one atomic group; groups
are ordered by doc_id and weigh their tokens.  The least shard capacity
for which a greedy walk over the ordered groups needs at most ``shards``
shards is found by binary search, then the groups are cut by that walk.
The largest shard is then as small as it can be.

Group sizes are packed in order into blocks of ``block`` groups in the
shared folder; the driver holds only each block's totals.  A walk makes at
most ``shards`` cuts, and each is found by searching the blocks' running
totals and then the sizes of the one block where the capacity is passed.
For any capacity c the i-th cut lies between i (c - largest) and i c tokens,
so the blocks that the whole search can touch are known beforehand and come
in one read; at most ``cached`` of them are kept, others are read when needed.

Defined cases: rows with NULL doc_id are one group, the first; NULL and
empty texts weigh 0; with fewer groups than shards the last shards stay
empty; an empty table has no shards.  A column named ``shard`` is replaced.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.base import pick, place, positional, stored
from reelgrid.llm.mixing import tokens_of


@dataclass(frozen=True)
class Params:
    shards: int = 32
    block: int = 16_384
    #: Bound on the blocks whose sizes the driver keeps (8 bytes a group).
    cached: int = 256


class Blocks:
    """Group sizes in order, of which only block totals are at hand; ``load`` reads the sizes of given blocks."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, load: Callable[[list[int]], dict[int, np.ndarray]], cached: int):
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.sums = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
        self.load, self.cached, self.kept = load, max(1, cached), OrderedDict()

    def prefetch(self, low: int, high: int, largest: int, shards: int) -> None:
        """Reads the blocks that a cut of any capacity from low to high can lie in, as far as they may be kept."""
        i = np.arange(1, shards)
        a = np.searchsorted(self.sums[1:], np.maximum(i * (low - largest), 0), side="right")
        b = np.minimum(np.searchsorted(self.sums[1:], i * high, side="right"), len(self.sums) - 2)
        want: dict[int, None] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            for k in range(x, y + 1):
                if len(want) >= self.cached:
                    break
                want[k] = None
        if want:
            self.kept.update(self.load(list(want)))

    def sizes(self, k: int) -> np.ndarray:
        if k not in self.kept:
            while len(self.kept) >= self.cached:
                self.kept.popitem(last=False)
            self.kept.update(self.load([k]))
        self.kept.move_to_end(k)
        return self.kept[k]


def walk(blocks: Blocks, capacity: int, most: int | None = None) -> list[int]:
    """First group of each shard but the first, by greedy filling; stops once there are ``most`` cuts."""
    cuts: list[int] = []
    full = 0
    while full + capacity < blocks.sums[-1]:
        k = int(np.searchsorted(blocks.sums[1:], full + capacity, side="right"))
        sums = np.cumsum(blocks.sizes(k))
        j = int(np.searchsorted(sums, full + capacity - int(blocks.sums[k]), side="right"))
        cuts.append(int(blocks.first[k]) + j)
        full = int(blocks.sums[k]) + (int(sums[j - 1]) if j else 0)
        if most is not None and len(cuts) >= most:
            break
    return cuts


def least_capacity(blocks: Blocks, largest: int, shards: int) -> int:
    """The smallest capacity that needs at most ``shards`` shards."""
    total = int(blocks.sums[-1])
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    blocks.prefetch(low, high, largest, shards)
    while low < high:
        mid = (low + high) // 2
        if len(walk(blocks, mid, shards)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def _packer(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = 0, 0
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("id").fill_null(-(2**63)).to_numpy()
            size = rows.column("size").to_numpy()
            cols = [[part], [seq], [len(size)], [int(size.sum())], [int(size.max())], [ids.astype(np.int64).tobytes()], [size.astype(np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "seq", "n", "total", "largest", "ids", "sizes"])

        for b in batches:
            if not len(b):
                continue
            part = b.column("part")[0].as_py()
            held.append(b)
            while sum(map(len, held)) >= block:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, block))
                seq += 1
                held = rows.slice(block).to_batches()
        if held and sum(map(len, held)):
            yield out(pa.Table.from_batches(held))

    return run


def bounds(docs: DataFrame, params: Params = Params()) -> list[int]:
    """First doc_id of each shard but the first."""
    p = params
    rows = pick(docs, id="doc_id:bigint", text="text")
    sizes = rows.select("id", tokens_of(F.col("text")).alias("n")).groupBy("id").agg(F.sum("n").alias("size"))
    order = sizes.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    packed = order.withColumn("part", F.spark_partition_id()).mapInArrow(_packer(p.block), "part bigint, seq bigint, n bigint, total bigint, largest bigint, ids binary, sizes binary")
    packed = stored(packed.withColumn("at", F.shiftleft("part", 40) + F.col("seq")))
    heads = packed.select("at", "n", "total", "largest").toArrow().sort_by("at")
    if not len(heads):
        return []
    at, n, total, largest = (heads.column(c).to_numpy() for c in ("at", "n", "total", "largest"))

    def load(column: str, which: list[int]) -> dict[int, np.ndarray]:
        """The given blocks' sizes or ids, in one read."""
        place = {int(at[k]): k for k in which}
        got = packed.where(F.col("at").isin(list(place))).select("at", column).toArrow()
        return {place[a]: np.frombuffer(raw, dtype=np.int64) for a, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)}

    blocks = Blocks(n, total, lambda which: load("sizes", which), p.cached)
    cuts = walk(blocks, least_capacity(blocks, int(largest.max()), p.shards))
    where = [int(np.searchsorted(blocks.first, c, side="right")) - 1 for c in cuts]
    ids = load("ids", list(dict.fromkeys(where))) if cuts else {}
    return [int(ids[k][c - blocks.first[k]]) for k, c in zip(where, cuts, strict=True)]


def shard_of(key: Column, first: list[int]) -> Column:
    """Number of the shard that holds a key."""
    if not first:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in first]), lambda b: b <= key)), F.lit(0))


def shards(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, tokens, shard) of every row."""
    first = bounds(docs, params)
    rows = pick(docs, doc_id="doc_id:bigint", text="text")
    return rows.select("doc_id", tokens_of(F.col("text")).alias("tokens"), F.when(F.col("doc_id").isNull(), 0).otherwise(shard_of(F.col("doc_id"), first)).alias("shard"))


def sharded(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """All rows and columns with their shard."""
    first = bounds(docs, params)
    flat = positional(docs)
    key = F.col(f"_{place(docs, 'doc_id')}").cast("bigint")
    keep = [i for i, c in enumerate(docs.columns) if c.lower() != "shard"]
    out = flat.select(*[F.col(f"_{i}") for i in keep], F.when(key.isNull(), 0).otherwise(shard_of(key, first)).alias("shard"))
    return out.toDF(*[docs.columns[i] for i in keep], "shard")
