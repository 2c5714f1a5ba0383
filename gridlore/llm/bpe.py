"""Byte-level BPE encoding by segment trees over adjacent pair ranks, and decoding.

A text is cut at the vocabulary's added tokens, then by the byte-level pretokenizer's rule into words.
A word's bytes are its first symbols. The leaves of a segment tree hold, for each symbol that has a
right neighbour, the rank of the merge of the two and the place; so the root is the leftmost merge of
lowest rank. A merge changes three leaves, each with a logarithmic climb, until the root is empty. Words
of up to SHORT bytes are merged side by side, one tree a row of an array; a longer word has a tree of
its own, so that one word of a million characters takes a million climbs and no quadratic time.

Words that a worker has met keep their ids, told by a 64-bit fingerprint; LIMIT words and KEPT ids at
most are held, then the memory starts anew. Every text is decoded and compared with itself, and one that
differs, as two words with one fingerprint would make it, is encoded without that memory. Null texts are
empty, empty ones have no ids; repeated rows and rows without a doc_id each have their own result; an
empty table has none. There is no shuffle: a lost executor costs the tasks it ran. Memory follows the
longest text of a row. The vocabulary's file must be where the executors are.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import words as W

#: Bytes of the longest words that are merged side by side; words and ids that a worker remembers.
SHORT, LIMIT, KEPT = 64, 1 << 18, 1 << 22
_NONE = np.iinfo(np.int64).max
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Code points with the property White_Space, and the endings that the pretokenizer parts from their word.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS_1, ENDINGS_2 = ("s", "t", "m", "d"), ("re", "ve", "ll")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def char_kinds() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.full(0x110000, _OTHER, np.uint8)
    out[first == "L"], out[first == "N"] = _LETTER, _NUMBER
    out[list(WHITE_SPACE)] = _SPACE
    return out


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (n of them) of each span, one span after another."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, ids = byte_chars(), spec["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(chars)}
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        of_id = {i: bytes(of_char[c] for c in t) for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        sizes = np.zeros(max(of_id) + 1, np.int64)
        for i, t in of_id.items():
            sizes[i] = len(t)
        self.size, self.at = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.byte_id = np.array([ids[c] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[self.order], np.array([ids[a + b] for a, b in pairs], np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.kinds = char_kinds()
        self.forget()

    def forget(self) -> None:
        self.seen, self.seen_at, self.seen_n, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    # words

    def pretokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Byte bounds of all words of texts, and the ids of those starts that are added tokens."""
        raw = data.tobytes()
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.zeros(len(code) + 1, np.int64)
        np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=at[1:])
        n, kind, special = len(code), self.kinds[code], {}
        if not n:
            return at[:0], at[:0], special
        if any(t in raw for t in self.added):
            find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                special |= {a + m.start(): a + m.end() for m in find.finditer(raw[a:b])}
        fresh = np.zeros(n + 1, bool)  # where a text, an added token or what follows one starts
        fresh[np.searchsorted(at, [*bounds.tolist(), *special, *special.values()])] = True
        start = fresh[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh[1:n])  # white space before a word
        start[last] = True
        start[last[code[last] == 0x20] + 1] = False
        tail = np.concatenate([code, np.zeros(2, np.uint32)])
        mark = np.flatnonzero((code == 0x27) & start & ~fresh[1:])
        one, two = tail[mark + 1], tail[mark + 2]
        long = np.zeros(len(mark), bool)
        for a, b in ENDINGS_2:
            long |= (one == ord(a)) & (two == ord(b))
        long &= ~fresh[np.minimum(mark + 2, n)]
        short = np.isin(one, [ord(c) for c in ENDINGS_1])
        mark, long = mark[short | long], long[short | long]
        start[mark + 1] = False
        after = mark + 2 + long
        start[after[after < n]] = True
        for a, b in special.items():
            start[np.searchsorted(at, a) + 1 : np.searchsorted(at, b)] = False
        begin = at[np.flatnonzero(start)]
        return begin, np.append(begin[1:], at[-1]), {a: self.added[raw[a:b]] for a, b in special.items()}

    # merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of two symbols, or _NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (left >= 0), self.order[k], _NONE)

    def merge_side_by_side(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. sym: a row of 2^k symbols a word, of which n count."""
        rows, size = sym.shape
        place = np.arange(size)
        sym = np.concatenate([np.where(place < n[:, None], sym, -1), np.full((rows, 1), -1, np.int32)], axis=1).ravel()
        wide = size + 1  # the last place of a row means none
        right = np.tile(np.append(place + 1, size), (rows, 1)).ravel()
        left = np.tile(np.append(np.append(size, place[:-1]), size), (rows, 1)).ravel()

        def leaf(base: np.ndarray, i: np.ndarray) -> np.ndarray:
            r = self.ranks(sym[base + i], sym[base + right[base + i]])
            return np.where(r == _NONE, _NONE, r * size + i)

        tree = np.full((rows, 2 * size), _NONE)
        at = np.repeat(np.arange(rows), size)
        tree[:, size:] = leaf(at * wide, np.tile(place, rows)).reshape(rows, size)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        tree, live = tree.ravel(), np.arange(rows)
        while len(live := live[tree[live * 2 * size + 1] != _NONE]):
            root, base, top = tree[live * 2 * size + 1], live * wide, live * 2 * size
            i = root % size
            j = right[base + i]
            k = right[base + j]
            sym[base + i], sym[base + j] = self.merged[root // size], -1
            right[base + i], left[base + k] = k, i
            before = left[base + i]
            before = np.where(before < size, before, i)
            tree[top + size + j] = _NONE
            tree[top + size + i] = leaf(base, i)
            tree[top + size + before] = leaf(base, before)
            climb = [(size + x) >> 1 for x in (j, i, before)]
            for _ in range(size.bit_length() - 1):
                for x in climb:
                    tree[top + x] = np.minimum(tree[top + 2 * x], tree[top + 2 * x + 1])
                climb = [x >> 1 for x in climb]
        sym = sym.reshape(rows, wide)
        return sym[sym >= 0], (sym >= 0).sum(axis=1)

    def merge_long(self, sym: list[int]) -> list[int]:
        """Ids of one word, by a tree of its own."""
        n, none = len(sym), _NONE
        size = 1 << max(1, (n - 1).bit_length())
        right, left, rank_of, merged = list(range(1, n + 1)), list(range(-1, n)), self.rank_of, self.merged.tolist()

        def leaf(i: int) -> int:
            j = right[i]
            r = rank_of.get(sym[i] << 32 | sym[j]) if j < n else None
            return none if r is None else r * size + i

        tree = [none] * size + [leaf(i) for i in range(n)] + [none] * (size - n)
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while (root := tree[1]) != none:
            i = root % size
            j = right[i]
            sym[i], sym[j], right[i] = merged[root // size], -1, right[j]
            left[right[j]] = i
            for x, key in ((j, none), (i, leaf(i)), *([(left[i], leaf(left[i]))] if left[i] >= 0 else ())):
                x += size
                tree[x] = key
                while x > 1:
                    x >>= 1
                    a, b = tree[2 * x], tree[2 * x + 1]
                    tree[x] = a if a < b else b
        return [s for s in sym if s >= 0]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these bytes, one word after another, and how many each has."""
        n = end - start
        count, parts = np.ones(len(n), np.int64), {}
        size = 2
        done = np.zeros(len(n), bool)
        while size <= SHORT:
            pick = np.flatnonzero((n <= size) & ~done)
            done[pick] = True
            if len(pick):
                sym = self.byte_id[data[np.minimum(start[pick, None] + np.arange(size), len(data) - 1)]]
                parts[size], count[pick] = self.merge_side_by_side(sym, n[pick])
                parts[size] = (pick, parts[size])
            size *= 2
        for k in np.flatnonzero(~done).tolist():
            got = np.array(self.merge_long(self.byte_id[data[start[k] : end[k]]].tolist()), np.int32)
            parts[-1 - k], count[k] = (np.array([k]), got), len(got)
        out, at = np.empty(count.sum(), np.int32), np.cumsum(count) - count
        for pick, got in parts.values():
            out[spans(at[pick], count[pick])] = got
        return out, count

    def remembered(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, which is asked for words not met before only."""
        print_, first, back = np.unique(W.span_hash(data, start, end), return_index=True, return_inverse=True)

        def unknown() -> np.ndarray:
            k = np.searchsorted(self.seen, print_)
            return first[(k == len(self.seen)) | (self.seen[np.minimum(k, len(self.seen) - 1)] != print_)] if len(self.seen) else first

        new = unknown()
        if len(self.seen) + len(new) > LIMIT or len(self.ids) > KEPT:
            self.forget()
            new = unknown()
        if len(new):
            ids, n = self.merge(data, start[new], end[new])
            prints = np.concatenate([self.seen, W.span_hash(data, start[new], end[new])])
            order = np.argsort(prints)
            self.seen_at = np.concatenate([self.seen_at, len(self.ids) + np.cumsum(n) - n])[order]
            self.seen, self.seen_n, self.ids = prints[order], np.concatenate([self.seen_n, n])[order], np.concatenate([self.ids, ids])
        k = np.searchsorted(self.seen, print_)[back]
        return self.ids[spans(self.seen_at[k], self.seen_n[k])], self.seen_n[k]

    # texts

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after another, and where each text's start."""
        ids, first = self._encode(data, bounds, self.remembered)
        back, at = self.decode(ids, first)
        if not (len(back) == len(data) and (at == bounds).all() and (back == data).all()):
            each = [self._encode(data[a:b], np.array([0, b - a]), self.merge)[0] for a, b in zip(bounds, bounds[1:])]
            ids, first = np.concatenate(each or [ids]), np.cumsum([0, *map(len, each)])
        return ids, first

    def _encode(self, data: np.ndarray, bounds: np.ndarray, merge) -> tuple[np.ndarray, np.ndarray]:
        start, end, special = self.pretokens(data, bounds)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
        ids, n = merge(data, start, end)
        if special:
            k = np.searchsorted(start, list(special))
            at, keep = np.cumsum(n) - n, np.ones(len(ids), bool)
            keep[spans(at[k] + 1, n[k] - 1)] = False
            ids[at[k]] = list(special.values())
            ids, n[k] = ids[keep], 1
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(start, bounds)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids, and where each list's start. Ids that the vocabulary doesn't have stand for nothing."""
        known = (ids >= 0) & (ids < len(self.size))
        n = np.where(known, self.size[np.where(known, ids, 0)], 0)
        ends = np.append(0, np.cumsum(n))
        return self.bytes[spans(self.at[ids[known]], n[known])], ends[first]


_tables: dict[str, Bpe] = {}


def tables(path: str | None) -> Bpe:
    """The vocabulary at path, read once a worker; by default byte_bpe_50k.json of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _tables:
        _tables[path] = Bpe(path)
    return _tables[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each text."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = tables(path).encode(*W.buffer(block.column(1)))
        return pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return C.map_blocks(C.documents(docs), fn, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids are none, and bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        for block in batches:
            lists = block.column(1)
            flat = lists.flatten().fill_null(-1)
            data, at = tables(path).decode(np.asarray(flat), np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())], names=["doc_id", "text"])

    return C.arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of the text decoded from them)."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tables(path)
        ids, first = bpe.encode(*W.buffer(block.column(1)))
        data, at = bpe.decode(ids, first)
        ids = ids.astype("<u4")
        cuts, marks = list(zip(first.tolist(), first[1:].tolist())), list(zip(at.tolist(), at[1:].tolist()))
        shas = [[hashlib.sha256(x[a:b]).hexdigest() for a, b in c] for x, c in ((ids, cuts), (data, marks))]
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(first), pa.int64()), *(pa.array(s, pa.string()) for s in shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.map_blocks(C.documents(docs), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
