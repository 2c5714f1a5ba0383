"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words (A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``); the patterns are
every window of ten consecutive words of a benchmark item, or the whole of a shorter one. For each
pattern length m there are the three tables of the method, over blocks of B = min(2, m) words:

- SHIFT: how far the search may move after the block that ends at a position; m - B + 1 where no
  pattern has the block, 0 where it ends a pattern;
- HASH: suffix-hash buckets, the patterns that end in a block;
- the words themselves, which confirm an occurrence by direct comparison.

All lanes (stretches of 256 words of a text, overlapping by m - 1) of a block of texts move at once,
each by its own shifts. Patterns are places in the items' words beside sorted fingerprints, 24 bytes a
word, and SHIFT has eight cells a pattern or more, so that it skips whatever the benchmark's size. The
item texts are broadcast in blocks of about `pattern_bytes` (longer items are cut, with the words of a
window in common); a larger benchmark takes several passes, each of which adds to the hits of those before.

Null texts and texts without words have no hits; rows of `benchmark` without words give no pattern; those
without item_id mark words but name no item; equal items each count; repeated rows of documents are each
reported; an empty benchmark hits nothing; columns of documents may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = str.maketrans({c: c + 32 for c in range(65, 91)})
_LANE, _MOST_BITS = 256, 26
#: Words of an item that stay together.
ITEM_WORDS = 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_AZ))


def _words(b: W.Block, at: int, m: int) -> bytes:
    return b" ".join(b.data[i:j].tobytes() for i, j in zip(b.start[at : at + m].tolist(), b.end[at : at + m].tolist()))


class Patterns:
    """The tables for the patterns of one length: m words from each of the starts in the items' words."""

    def __init__(self, m: int, items: W.Block, h: np.ndarray, starts: np.ndarray, names: list[str | None]):
        self.m, self.block, self.items, self.names = m, min(2, m), items, names
        keys = W.gram_hashes(h, m)[starts]
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order]
        grams = W.gram_hashes(h, self.block)
        self.mask = np.uint64((1 << min(_MOST_BITS, max(12, (8 * len(starts)).bit_length()))) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint8 if m < 256 else np.int64)
        for q in range(m, self.block - 1, -1):  # the block that ends at word q
            cell = (grams[starts + q - self.block] & self.mask).astype(np.int64)
            self.shift[cell] = np.minimum(self.shift[cell], m - q)
        self.suffixes = np.unique(grams[starts + m - self.block])
        self.seen: dict[int, dict[bytes, list[str]]] = {}

    def owners(self, key: int, words: bytes) -> list[str] | None:
        """Items that have these words, by comparison of the words themselves; null if none has."""
        if key not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            lo, hi = np.searchsorted(self.keys, [key], "left")[0], np.searchsorted(self.keys, [key], "right")[0]
            found: dict[bytes, set[str]] = defaultdict(set)
            for at in self.starts[lo:hi].tolist():
                name = self.names[self.items.doc[at]]
                found[_words(self.items, at, self.m)].update(() if name is None else (name,))
            self.seen[key] = {k: sorted(v) for k, v in found.items()}
        return self.seen[key].get(words)

    def search(self, b: W.Block, h: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Where occurrences start, and the items that own each."""
        m, size, mask = self.m, self.block, self.mask
        n = np.maximum(b.n_words - m + 1, 0)  # windows
        grams = W.gram_hashes(h, size)
        lanes = -(-n // _LANE)
        doc = np.repeat(np.arange(b.n_docs), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = b.first[doc] + nth * _LANE
        pos = start + m - 1
        last = np.minimum(start + _LANE, b.first[doc] + n[doc]) + m - 2
        found = []
        while len(pos):
            move = self.shift[(grams[pos - size + 1] & mask).astype(np.int64)].astype(np.int64)
            found.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            on = pos <= last
            pos, last = pos[on], last[on]
        ends = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
        if len(ends):
            tail = grams[ends - size + 1]
            k = np.minimum(np.searchsorted(self.suffixes, tail), len(self.suffixes) - 1)
            ends = ends[self.suffixes[k] == tail]
        if len(ends):
            windows = W.gram_hashes(h, m)[ends - m + 1]
            k = np.minimum(np.searchsorted(self.keys, windows), len(self.keys) - 1)
            on = self.keys[k] == windows
            ends, windows = ends[on], windows[on]
        starts, whose = [], []
        for e, key in zip(ends.tolist(), windows if len(ends) else ()):
            owner = self.owners(key, _words(b, e - m + 1, m))
            if owner is not None:
                starts.append(e - m + 1)
                whose.append(owner)
        return np.array(starts, np.int64), whose


def compile_patterns(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    b = W.split(pa.array([t or "" for _, t in items], pa.large_string()), W.ALNUM, lower=True)
    h, names, n = W.word_hashes(b), [i for i, _ in items], b.n_words
    out = []
    for m in np.unique(np.minimum(n[n > 0], window)).tolist():
        starts = W.gram_starts(b, window) if m == window else b.first[:-1][n == m]
        out.append(Patterns(m, b, h, starts, names))
    return out


def _scanner(items: list[tuple[str | None, str | None]], window: int):
    """From texts and the hits so far (words as 4-byte numbers, item ids) to hits; built once a worker."""
    tables: list[Patterns] = []

    def scan(col: pa.Array, held: list[tuple[bytes, list[str]]] | None) -> list[tuple[bytes, list[str]]]:
        if not tables and items:
            tables.extend(compile_patterns(items, window))
        b = W.split(col, W.ALNUM, lower=True)
        h = W.word_hashes(b)
        hit, of = np.zeros(len(h), bool), [set(x[1]) if x else set() for x in held] if held else [set() for _ in range(b.n_docs)]
        for d, x in enumerate(held or []):
            hit[b.first[d] + np.frombuffer(x[0], np.uint32)] = True
        for p in tables:
            starts, whose = p.search(b, h)
            hit |= W.cover(starts, p.m, len(h))
            for d, owner in zip(b.doc[starts].tolist(), whose):
                of[d].update(owner)
        at = np.flatnonzero(hit)
        bounds = np.searchsorted(at, b.first)
        return [((at[bounds[d] : bounds[d + 1]] - b.first[d]).astype(np.uint32).tobytes(), sorted(of[d])) for d in range(b.n_docs)]

    return scan


def item_blocks(benchmark: DataFrame, pattern_bytes: int, window: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in parts of about pattern_bytes, one in the driver at a time for each broadcast; equal rows once, long items in pieces."""

    def pieces(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                step = max(1, ITEM_WORDS - window + 1)
                out += [(item, " ".join(w[k : k + ITEM_WORDS])) for k in range(0, max(1, len(w) - window + 1), step) if w]
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["item", "text"])

    b = C.cut(C.arrow(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("text is not null"), pieces, "item string, text string").distinct())
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // pattern_bytes))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def mark_names(columns: list[str]) -> tuple[str, str]:
    """Names for the two columns of hits that no column has."""
    names = ("_hits", "_items")
    while set(names) & set(columns):
        names = tuple(f"_{n}" for n in names)
    return names


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = 16 << 20) -> DataFrame:
    """docs with two more columns (mark_names): hit words as 4-byte numbers, and item ids as sorted strings."""
    spark = docs.sparkSession
    names, marks = docs.columns, mark_names(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(marks[0], T.BinaryType()), T.StructField(marks[1], T.ArrayType(T.StringType()))])
    out = docs
    for k, items in enumerate(item_blocks(benchmark, pattern_bytes, window)):
        shared = spark.sparkContext.broadcast(items)
        state: dict = {}

        def fn(block: pa.RecordBatch, shared=shared, k=k, state=state) -> pa.RecordBatch:
            scan = state.get(0) or state.setdefault(0, _scanner(shared.value, window))
            index = block.schema.get_field_index
            held = list(zip(*(block.column(index(m)).to_pylist() for m in marks))) if k else None
            found = scan(block.column(index("text")), held)
            cols = [block.column(index(n)) for n in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.string()))], [*names, *marks])

        out = C.map_blocks(out, fn, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        b = W.split(block.column(1), W.ALNUM, lower=True)
        n_hit = [len(x) // 4 for x in block.column(2).to_pylist()]
        items = block.column(3).to_pylist()
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        cols = [block.column(0), pa.array(b.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array([x > 0 for x in n_hit])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return C.map_blocks(hits(C.documents(docs), benchmark, window), fn, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the hit words: each run of them, with what stands between its words, becomes one space; n_chars, if there, follows."""
    schema, mark = docs.schema, mark_names(docs.columns)[0]

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: block.column(block.schema.get_field_index(n)) for n in schema.names}
        texts, marks = cols["text"], block.column(block.schema.get_field_index(mark)).to_pylist()
        if any(marks):
            b = W.split(texts, W.ALNUM, lower=True)
            new = texts.to_pylist()
            for d, m in enumerate(marks):
                if m:
                    w = np.frombuffer(m, np.uint32).astype(np.int64) + b.first[d]
                    gap = np.flatnonzero(np.diff(w) > 1)
                    firsts, lasts = w[np.concatenate([[0], gap + 1])], w[np.concatenate([gap, [len(w) - 1]])]
                    parts, at = [], b.bounds[d]
                    for s, e in zip(b.start[firsts].tolist(), b.end[lasts].tolist()):
                        parts.append(b.raw[at:s].tobytes())
                        at = e
                    new[d] = b" ".join([*parts, b.raw[at : b.bounds[d + 1]].tobytes()]).decode()
            cols["text"] = pa.array(new, pa.string()).cast(texts.type)
            if "n_chars" in cols:
                cols["n_chars"] = pc.utf8_length(cols["text"]).cast(cols["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return C.map_blocks(hits(docs, benchmark, window), fn, schema)
