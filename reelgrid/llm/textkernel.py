"""Vectorised tokenising of Arrow text columns.

A token is a maximal run of ASCII letters, digits, underscores and
non-ASCII characters, with ASCII and Latin-1 capitals folded to small
letters.  Folding never changes a byte length, so offsets point into the
original text.  Every helper works on whole Arrow columns with numpy: no
Python code runs per word or per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ_BASE = 0xD6E8FEB86659FD93 | 1
_M64 = (1 << 64) - 1

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_word = np.zeros(256, dtype=bool)
_word[48:58] = _word[97:123] = _word[95] = True
_word[128:] = True

TOKEN_RE = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
FOLD = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def plain_tokens(text: str | None) -> list[str]:
    """The same tokens by ordinary Python, for tests and small driver-side lists."""
    return TOKEN_RE.findall((text or "").translate(FOLD))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_bytes_powers, _seq_powers = _Powers(_BASE), _Powers(_SEQ_BASE)


@dataclass
class Tokens:
    """Tokens of several texts one after another.

    ``hash`` holds one 64-bit value a token, ``start``/``end`` byte
    offsets into ``data``, ``offs`` the first token of each text (one
    more entry than texts), ``base`` the first byte of each text.
    """

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray
    base: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))


def folded_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes with capitals folded, and the offsets of its texts; NULL counts as empty."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col) or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    data = _fold[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    lead = lead[(raw[lead] <= 0x9E) & (raw[lead] >= 0x80) & (raw[lead] != 0x97)]
    data[lead] += 32
    return data, offs - offs[0]


def tokenize(col: pa.Array) -> Tokens:
    data, base = folded_bytes(col)
    n = len(data)
    if not n:
        e = np.zeros(0, dtype=np.int64)
        return Tokens(np.zeros(0, dtype=_U), e, e, np.zeros(len(base), dtype=np.int64), base, data)
    word = _word[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = base[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _bytes_powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start])
    return Tokens(h, start, end, np.searchsorted(start, base), base, data)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp value of every run of ``width`` tokens (runs may cross texts; mask them out)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _seq_powers.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """One value for each given token span [start, end)."""
    up, down = _seq_powers.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum((mix(h + _U(salt)) if salt else h) * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def windows_inside(offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and text index of every window of ``width`` tokens that lies within one text."""
    per = np.maximum(np.diff(offs) - width + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    return np.arange(per.sum()) - first[doc] + offs[:-1][doc], doc


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch at row borders into pieces of about ``limit`` bytes of text, whole texts only."""
    col = batch.column(column)
    if not len(col):
        return
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    piece = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(col)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Characters before each byte, so that byte offsets become character offsets."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
