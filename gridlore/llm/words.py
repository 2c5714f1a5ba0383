"""Array kernels over a block of texts: word bounds, word and n-gram fingerprints.

Texts stay in Arrow's UTF-8 buffer; every step is one pass of numpy over its bytes or words, so no
Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_LEFT, _RIGHT, _PLACE = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)
#: Masks of the lowest 0 to 8 bytes of a number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def byte_table(separators: set[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = byte_table({0x20, *range(0x09, 0x0E)})
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALNUM = byte_table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Block:
    data: np.ndarray  #: bytes of all texts
    bounds: np.ndarray  #: where each text starts, and the end
    start: np.ndarray  #: of words
    end: np.ndarray
    doc: np.ndarray  #: of words
    first: np.ndarray  #: first word of each text, and the number of words
    raw: np.ndarray  #: bytes before lower-casing

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and len(off) and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - (off[0] if len(off) else 0)


def runs(flag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of set bytes that don't pass a text's bounds."""
    n = len(flag)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def split(col: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Block:
    raw, bounds = buffer(col)
    data = LOWER[raw] if lower else raw
    start, end = runs(table[data], bounds)
    first = np.searchsorted(start, bounds)
    return Block(data, bounds, start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first, raw)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans: eight bytes at a time, each mixed with its place, summed and mixed with the length.

    Spans of eight bytes or fewer differ in them for certain if they are of one length. No sum or product of
    the bytes themselves is taken, so that no pattern in a text makes others collide.
    """
    n = end - start
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((wide[start] & _BYTES[np.minimum(n, 8)]) * _LEFT + _PLACE)
    long = np.flatnonzero(n > 8)
    if len(long):
        k = (n[long] - 1) >> 3  # eights after the first
        at = np.cumsum(k) - k
        place = np.arange(k.sum()) - np.repeat(at, k) + 1
        where = np.repeat(start[long], k) + 8 * place
        left = np.repeat(end[long], k) - where
        more = mix((wide[where] & _BYTES[np.minimum(left, 8)]) * _LEFT + (place + 1).astype(_U) * _PLACE)
        out[long] += np.add.reduceat(more, at)
    return mix(out ^ (n.astype(_U) * _RIGHT))


def word_hashes(b: Block) -> np.ndarray:
    """Fingerprints of all words."""
    return span_hash(b.data, b.start, b.end)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _LEFT + b * _RIGHT + _PLACE)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive words, len(h) - n + 1 of them, over text bounds too: those of powers of two, joined."""
    if len(h) < n:
        return np.empty(0, _U)
    power, size, out, have = h, 1, None, 0
    while size <= n:
        if n & size:  # the lower powers stand before
            out, have = (power if out is None else _joined(out[: len(h) - have - size + 1], power[have:])), have + size
        if 2 * size <= n:
            power = _joined(power[:-size], power[size:])
        size *= 2
    return mix(out[: len(h) - n + 1] + _U(n))


def window_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Words where n consecutive words of one text start; doc: each word's text."""
    return np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.empty(0, np.int64)


def gram_starts(b: Block, n: int) -> np.ndarray:
    return window_starts(b.doc, n)


def cover(starts: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """Which of size words lie in a span of n words from one of the starts."""
    starts = np.asarray(starts)
    if not len(starts):
        return np.zeros(size, bool)
    d = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(d[:size]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points start before each byte, and in all."""
    out = np.empty(len(data) + 1, np.int64)
    out[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one for each word or byte) for each text."""
    s = np.concatenate([[0], np.cumsum(values)])
    return s[first[1:]] - s[first[:-1]]
