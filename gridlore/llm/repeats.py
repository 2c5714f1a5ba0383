"""Substring dedup with prefix-partitioned suffix trees over words.

The text of the trees is all words of all documents; a suffix starts at each word that twelve others
of its document follow, and is read to its thirteenth word.

1. Variable-length prefixes split the suffixes: a prefix is one to LEVELS symbols (five bits of a
   word's fingerprint each), lengthened only where more suffixes than a group may hold start with it;
   neighbouring prefixes are then put together up to that size.
2. A suffix that shares its thirteen words with no other chunk of texts hangs from a node of lesser
   depth in its group's tree, so it can be left out there. Which these are is found by fingerprints
   that grow with the corpus (7 bits more than it takes to number its suffixes): a filter, which
   passes all others and about one in a hundred of them.
3. A group gets what passed, for each distinct suffix of a chunk its thirteen words as symbols (eight
   bits of a word's fingerprint each) and one fingerprint of all. It sorts the suffixes by their symbols
   and makes its subtree from the common prefixes of neighbours (`Subtree`). An internal node of depth 13
   with leaves of several chunks is a repeat; the group tells each of these whether the node has a leaf
   of a lesser document's chunk.
4. Repeats among the documents of one chunk are nodes of the chunk's own suffixes. A word goes if a
   repeat that also starts in a document with a lesser doc_id covers it. Repeats that start one word
   after another are one maximal repeat: `maximal` gives those.

Suffixes of one chunk with equal words travel as one, so the tasks' sizes don't depend on how often a
passage occurs. Words are told apart by 64-bit fingerprints (which differ for certain for words of one
length up to eight bytes), sequences of them within a chunk by these, between chunks by a symbol a word
and a 64-bit fingerprint: two that differ in one word only are taken for equal with a probability of
2^-72. Null and empty texts have no words; of rows with equal doc_id neither is smaller; a null doc_id
counts as smaller than all others, and rows without one as equal; texts are read whole; an empty table
gives none. Nothing is written but shuffles: a lost executor costs the tasks that made its part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import common as C
from . import exchange as X
from . import words as W

WINDOW, LEVELS, BITS = 13, 3, 5
#: Bits of the filter's fingerprints beyond those that number all suffixes.
SPARE_BITS = 7


class Subtree:
    """The suffix tree of some suffixes: their rows of symbols in order, and how many words neighbours have in common.

    label: fingerprints that tell apart suffixes with the same symbols; such ones have not all words in common.
    """

    def __init__(self, rows: np.ndarray, label: np.ndarray | None = None):
        self.width = rows.shape[1]
        self.order = np.lexsort([*([] if label is None else [label]), *rows.T[::-1]]) if len(rows) else np.empty(0, np.int64)
        r = rows[self.order]
        differ = r[1:] != r[:-1]
        if label is not None and len(r):
            differ[:, -1] |= label[self.order][1:] != label[self.order][:-1]
        self.common = np.where(differ.any(1), differ.argmax(1), self.width) if len(r) else np.empty(0, np.int64)

    def internal(self, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, first leaf, past the last leaf) of the internal nodes of depth `least` or more, as places in order, by depth."""
        out = []
        for depth in range(least, self.width + 1):
            on = np.concatenate([[False], self.common >= depth, [False]])
            first, last = np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:]) + 1
            if depth < self.width and len(first):  # a node branches here if two neighbours in it have no more in common
                at = np.concatenate([[0], np.cumsum(self.common == depth)])
                here = at[last - 1] > at[first]
                first, last = first[here], last[here]
            out.append((depth, first, last))
        return out


def prefix_codes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LEVELS symbols, the first word's highest."""
    code = np.zeros(len(starts), np.int64)
    for k in range(LEVELS):
        code = code << BITS | (h[starts + k] >> np.uint64(64 - BITS)).astype(np.int64)
    return code


def prefix_counts(docs: DataFrame, window: int) -> np.ndarray:
    """How many suffixes have each prefix of LEVELS symbols: a bounded table."""
    size = 1 << (LEVELS * BITS)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for block in C.text_blocks(batch):
                b = W.split(block.column(0))
                total += np.bincount(prefix_codes(W.word_hashes(b), W.gram_starts(b, window)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    out = np.zeros(size, np.int64)
    for r in C.arrow(docs.select("text"), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def prefixes(counts: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(length, first code, codes) of a cover by prefixes that are no longer than `most` suffixes ask for."""
    out: list[tuple[int, int, int]] = []

    def cover(level: int, at: int, width: int) -> None:
        if not level or (level < LEVELS and counts[at : at + width].sum() > most):
            step = width >> BITS
            for k in range(1 << BITS):
                cover(level + 1, at + k * step, step)
        else:
            out.append((level, at, width))

    cover(0, 0, len(counts))
    return out


def group_table(counts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each code: prefixes in order, put together up to a group's share."""
    most, table, group, held = max(1, int(counts.sum()) // groups), np.zeros(len(counts), np.int32), 0, 0
    for _, at, width in prefixes(counts, most):
        n = int(counts[at : at + width].sum())
        if held and held + n > most and group < (1 << LEVELS * BITS) - 1:
            group, held = group + 1, 0
        table[at : at + width] = group
        held += n
    return table


@dataclass
class Suffixes:
    """The suffixes of a chunk's texts, in the order of their words' fingerprint, those of lesser documents first."""

    words: np.ndarray  #: fingerprints
    doc: np.ndarray  #: text number of each word
    rank: np.ndarray  #: of the texts, by doc_id
    start: np.ndarray
    label: np.ndarray
    new: np.ndarray  #: where suffixes with other words begin


def by_id(t: pa.Table) -> pa.Table:
    """The texts of a chunk in the order of doc_id, those without one first."""
    ids = t.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    return t.take(pa.array(np.argsort(ids, kind="stable")))


def suffixes(t: pa.Table, window: int) -> Suffixes:
    """Of the texts of a chunk, which are sorted by doc_id."""
    h, doc = X.chunk_words(t.column("text"), W.SPACED, False)
    start = W.window_starts(doc, window)
    ids = t.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) if len(ids) else ids
    label = W.gram_hashes(h, window)[start] if len(start) else np.empty(0, np.uint64)
    order = np.argsort(label)
    label = label[order]
    same = label[1:] == label[:-1]
    if same.any():  # of equal ones the earliest, which is of the least document, comes first
        held = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        order[held] = order[held][np.lexsort((order[held], label[held]))]
    start = start[order]
    at = np.flatnonzero(same)
    for k in range(window):  # equal fingerprints are confirmed by those of the words
        same[at] &= h[start[at + 1] + k] == h[start[at] + k]
    return Suffixes(h, doc, rank, start, label, np.flatnonzero(np.concatenate([[True], ~same])) if len(start) else at)


def filter_keys(s: Suffixes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """`bits` of the distinct suffixes' fingerprints, as keys of the exchange, each once; and each suffix's place among them."""
    keys = (s.label[s.new] >> np.uint64(64 - bits)) << np.uint64(X.KEY_BITS - bits)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    return keys[new], np.cumsum(new) - 1


def _passed(s: Suffixes, bits_of: dict[int, bytes], bits: int, groups: int) -> np.ndarray:
    """Distinct suffixes (places in s.new) that the filter passes."""
    keys, place = filter_keys(s, bits)
    grp = X.key_group(keys, groups)
    passed = np.zeros(len(keys), bool)
    for g, raw in bits_of.items():
        a, b = np.searchsorted(grp, [g, g + 1])
        passed[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
    return np.flatnonzero(passed[place])


def _dealt(s: Suffixes, k: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct suffixes by the group of their prefix, and these."""
    group = table[prefix_codes(s.words, s.start[s.new[k]])] if len(k) else np.empty(0, np.int32)
    order = np.argsort(group, kind="stable")
    return k[order], group[order]


def repeated_words(docs: DataFrame, finish, schema: str, window: int = WINDOW) -> DataFrame:
    """finish(texts of a chunk, removed words, text number of each word) -> RecordBatch, for each chunk."""
    spark = docs.sparkSession
    ship(spark)
    plan = X.layout(docs)
    counts = prefix_counts(docs, window)
    bits = min(X.KEY_BITS, max(24, int(counts.sum()).bit_length() + SPARE_BITS))
    shared = spark.sparkContext.broadcast((group_table(counts, plan.groups), plan))
    parts, groups = X.chunked(docs, plan), plan.groups

    def ask(t: pa.Table) -> pa.Table:
        keys = filter_keys(suffixes(by_id(t), window), bits)[0]
        cols = list(zip(*X.messages(keys, X.key_group(keys, groups)))) or [(), (), ()]
        chunk = t.column("chunk")[0].as_py() if len(t) else 0
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([chunk] * len(cols[0]), pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["grp", "chunk", "n", "keys"])

    def reply(run, n, held, distinct, above):
        """A bit for each entry: another chunk has its key."""
        other = np.bincount(run, minlength=distinct) > 1
        if above is not None:
            replies, sizes = above
            other |= np.concatenate([np.zeros(k, bool) if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8), count=k).astype(bool) for raw, k in zip(replies.column("bits").to_pylist(), sizes.tolist())])
        ends = np.cumsum(n)
        return [pa.array([np.packbits(other[run[e - k : e]]).tobytes() if other[run[e - k : e]].any() else None for e, k in zip(ends.tolist(), n.tolist())], pa.binary())]

    def send(t: pa.Table, replies: pa.Table) -> pa.Table:
        """What passed the filter, to the groups of its prefixes; and to the chunk itself, past the groups, which these are."""
        rows = []
        if len(t):
            table, plan = shared.value
            s = suffixes(by_id(t), window)
            places = _passed(s, dict(zip(replies.column("grp").to_pylist(), replies.column("bits").to_pylist())), bits, groups)
            k, group = _dealt(s, places, table)
            chunk = t.column("chunk")[0].as_py()
            rank, at = plan.rank(chunk), s.start[s.new[k]]
            symbols, label = np.empty((window, len(k)), np.uint8), s.label[s.new[k]]
            for j in range(window):
                symbols[j] = s.words[at + j] >> np.uint64(32)
            rows = [(g, chunk, rank, n, keys, cols) for g, n, keys, cols in X.messages(label, group, lambda a, b: np.ascontiguousarray(symbols[:, a:b]).tobytes())]
            mark = np.zeros(len(s.new), bool)
            mark[places] = True
            rows.append((-1 - chunk, chunk, rank, len(mark), np.packbits(mark).tobytes(), b""))
        cols = list(zip(*rows)) or [()] * 6
        return pa.table([*(pa.array(c, pa.int32()) for c in cols[:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], ["grp", "chunk", "rank", "n", "keys", "symbols"])

    def tree(t: pa.Table) -> pa.Table:
        """A bit for each suffix of each chunk: its node in the group's subtree has a leaf of a lesser chunk."""
        if t.column("grp")[0].as_py() < 0:
            return t.select(["grp", "chunk", "keys"]).rename_columns(["grp", "chunk", "bits"])
        n = t.column("n").to_numpy()
        label = np.concatenate([X.unpack_keys(raw, k) for raw, k in zip(t.column("keys").to_pylist(), n.tolist())])
        sub = Subtree(np.concatenate([np.frombuffer(raw, np.uint8).reshape(window, -1).T for raw in t.column("symbols").to_pylist()]), label)
        rank = np.repeat(t.column("rank").to_numpy(), n)[sub.order]
        again = np.zeros(len(rank), bool)
        for _, first, last in sub.internal(window):
            if len(first):
                least = np.minimum.reduceat(np.append(rank, 0), np.stack([first, last], 1).ravel())[::2]
                size = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                again[sub.order[at]] |= rank[at] > np.repeat(least, size)
        ends = np.cumsum(n)
        out = [np.packbits(again[e - k : e]).tobytes() if again[e - k : e].any() else None for e, k in zip(ends.tolist(), n.tolist())]
        return pa.table([t.column("grp"), t.column("chunk"), pa.array(out, pa.binary())], ["grp", "chunk", "bits"]).filter(pa.array([x is not None for x in out]))

    def apply(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_batches([finish(t, np.empty(0, bool), np.empty(0, np.int64))])
        t = by_id(t)
        s = suffixes(t, window)
        gone = np.zeros(len(s.doc), bool)
        if len(s.start):
            earlier = np.zeros(len(s.new), bool)
            bits_of = dict(zip(replies.column("grp").to_pylist(), replies.column("bits").to_pylist()))
            mark = np.unpackbits(np.frombuffer(next(raw for g, raw in bits_of.items() if g < 0), np.uint8), count=len(s.new))
            k, group = _dealt(s, np.flatnonzero(mark), shared.value[0])
            for g, raw in bits_of.items():
                if g >= 0:
                    a, b = np.searchsorted(group, [g, g + 1])
                    earlier[k[a:b]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
            run = np.repeat(np.arange(len(s.new)), np.diff(np.append(s.new, len(s.start))))
            rank = s.rank[s.doc[s.start]]
            gone = W.cover(s.start[earlier[run] | (rank > rank[s.new][run])], window, len(s.doc))
        return pa.Table.from_batches([finish(t, gone, s.doc)])

    asks = parts.groupBy("chunk").applyInArrow(ask, "grp int, chunk int, n int, keys binary")
    passed = X.resolve(asks, plan.chunks, groups, [], reply, "grp int, chunk int, bits binary", lambda grp, groups: (groups, 0)).where("bits is not null")
    sent = parts.groupBy("chunk").cogroup(passed.groupBy("chunk")).applyInArrow(send, "grp int, chunk int, rank int, n int, keys binary, symbols binary")
    marked = sent.groupBy("grp").applyInArrow(tree, "grp int, chunk int, bits binary")
    return parts.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(apply, schema)


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with with_text the kept words joined by spaces."""

    def finish(t: pa.Table, gone: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        bounds = np.searchsorted(doc, np.arange(len(t) + 1))
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[bounds[1:]] - removed[bounds[:-1]]
        digests, texts = [], []
        for d, text in enumerate(t.column("text")):
            w = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if removed[d]:
                w = compress(w, (~gone[bounds[d] : bounds[d + 1]]).tolist())
            kept = b" ".join(w)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        cols = [t.column("doc_id").combine_chunks(), pa.array(np.diff(bounds), pa.int64()), pa.array(removed.astype(np.int64)), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if with_text else cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    return repeated_words(C.documents(docs), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text, window)


def maximal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start and length in words of each maximal stretch of repeats that dedup takes out."""

    def finish(t: pa.Table, gone: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        first = np.searchsorted(doc, np.arange(len(t) + 1))
        on = np.flatnonzero(gone & ~(np.concatenate([[False], gone[:-1] & (doc[1:] == doc[:-1])]) if len(gone) else gone))
        off = np.flatnonzero(gone & ~(np.concatenate([gone[1:] & (doc[1:] == doc[:-1]), [False]]) if len(gone) else gone))
        return pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().take(pa.array(doc[on])), pa.array(on - first[doc[on]]), pa.array(off - on + 1)], ["doc_id", "start", "length"])

    return repeated_words(C.documents(docs), finish, "doc_id long, start long, length long", window)
