"""Corpus statistics without a row for each word: chunks of texts trade sorted key sets with groups of keys.

A chunk is a range of doc_id with about chunk_bytes of text (a doc_id with more is dealt over several
chunks by its texts). It tells each group of keys which of the group's keys it has (each once, so a passage
that very many texts share costs one entry a chunk), as differences of sorted fingerprints. The group
answers with a bit or a count for each key, in the same order; the chunk, dealt out again the same way,
applies the answers.

There are FAN groups at most, so that messages stay worth their rows. Where there are more than FAN chunks,
those of each FAN chunks are merged for each group first, the merged ones are dealt to finer groups, and
their answers are passed down: no task holds more than FAN messages of a size, whatever the corpus. With
8 MB a chunk that is two levels to 8 TB of text and three beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import words as W

CHUNK_BYTES, FAN = 8 << 20, 1024
KEY_BITS = 56
KEY = np.uint64((1 << KEY_BITS) - 1)
_STEPS, _WIDE = np.array([253, 1 << 16, 1 << 32]), ("<u2", "<u4", "<u8")
_NONE = -(1 << 63)


@dataclass
class Layout:
    bytes: int
    bounds: np.ndarray  #: least doc_id of each range, the first one's below all
    base: np.ndarray  #: first chunk of each range
    chunks: int
    groups: int

    def rank(self, chunk: int) -> int:
        """Chunks of one doc_id have one rank, others are in its order."""
        return int(self.base[np.searchsorted(self.base, chunk, side="right") - 1])


def layout(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = CHUNK_BYTES) -> Layout:
    """Ranges of doc_id by bytes of text: one exchange of ids and sizes; the driver gets a row for each range. A null doc_id is below all."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.octet_length("text").cast("long").alias("size"))

    def ranges(batches) -> Iterator[pa.RecordBatch]:
        start, last, held, own = None, None, 0, 0
        out: list[tuple[int, int]] = []
        for b in batches:
            ids, size = (b.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
            for i, x in zip(ids[cuts].tolist(), np.add.reduceat(size, cuts).tolist() if len(cuts) else ()):
                if i == last:
                    own += x
                    continue
                if start is not None and (held + own >= chunk_bytes or own >= chunk_bytes):
                    out += [(start, held)] * (held > 0 and start != last) + [(last, own)] if own >= chunk_bytes else [(start, held + own)]
                    start, held = i, 0
                else:
                    held += own
                    start = i if start is None else start
                last, own = i, x
        if start is not None:
            out += [(start, held)] * (held > 0 and start != last) + [(last, own)] if own >= chunk_bytes else [(start, held + own)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["id", "bytes"])

    ship(docs.sparkSession)
    found = sorted(tuple(r) for r in sizes.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(ranges, "id long, bytes long").collect())
    bounds, parts, held, total = [], [], 0, 0
    for i, size in found:
        total += size
        if size >= chunk_bytes or not bounds or held + size > chunk_bytes:
            bounds.append(i)
            parts.append(max(1, -(-size // chunk_bytes)) if size >= 2 * chunk_bytes else 1)
            held = size if size < chunk_bytes else 2 * chunk_bytes  # nothing joins a full one
        else:
            held += size
    if bounds:
        bounds[0] = _NONE
    base = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64) if parts else np.zeros(2, np.int64)
    return Layout(total, np.array(bounds or [_NONE], np.int64), base[:-1] if parts else base[:1], max(1, int(base[-1])), int(min(FAN, max(1, -(-total // group_bytes)))))


def chunked(docs: DataFrame, plan: Layout, *more: Column) -> DataFrame:
    """docs with their chunk. The bounds go to the executors as a broadcast of 16 bytes a chunk, not into the plan."""
    if plan.chunks == 1:
        return docs.select(F.lit(0).alias("chunk"), "doc_id", "text", *more)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((plan.bounds, plan.base, plan.chunks))

    @F.pandas_udf("int")
    def chunk(ids: pd.Series, salt: pd.Series) -> pd.Series:
        bounds, base, chunks = shared.value
        k = np.searchsorted(bounds, ids.to_numpy(), side="right") - 1
        parts = np.diff(np.append(base, chunks))[k]
        return pd.Series((base[k] + salt.to_numpy() % parts).astype(np.int32))

    salt = F.xxhash64("text") if plan.chunks > len(plan.bounds) else F.lit(0).cast("long")
    return docs.select(chunk(F.coalesce("doc_id", F.lit(_NONE)), salt).alias("chunk"), "doc_id", "text", *more)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(width, n).T
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """A byte each; 253, 254 and 255 stand for counts that follow in 2, 4 and 8 bytes."""
    size = np.searchsorted(_STEPS, c, side="right")
    return np.where(size > 0, 252 + size, c).astype(np.uint8).tobytes() + b"".join(c[size == k].astype(kind).tobytes() for k, kind in enumerate(_WIDE, 1))


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    c, at = np.frombuffer(raw, np.uint8, n).astype(np.int64), n
    marks = [np.flatnonzero(c == 252 + k) for k in range(1, 4)]
    for m, kind in zip(marks, _WIDE):
        c[m] = np.frombuffer(raw, kind, len(m), at)
        at += len(m) * np.dtype(kind).itemsize
    return c


def chunk_words(text: pa.ChunkedArray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and text number of all words of a column, a block at a time."""
    from .common import text_blocks

    hashes, docs, at = [], [], 0
    for batch in pa.table({"text": text}).to_batches():
        for block in text_blocks(batch):
            b = W.split(block.column(0), table, lower)
            hashes.append(W.word_hashes(b))
            docs.append(b.doc + at)
            at += b.n_docs
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def key_group(keys: np.ndarray, share: int) -> np.ndarray:
    """The group of KEY_BITS keys among `share` equal ranges of them; those of share * n are parts of those of share."""
    return (keys >> np.uint64(KEY_BITS - 32)).astype(np.int64) * share >> 32


def by_group(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by group and key (earlier entries first), where new keys start in it, and each new key's group."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(group[order].astype(np.uint16), kind="stable")]
    k, g = keys[order], group[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])) if len(k) else np.empty(0, np.int64)
    return order, new, g[new]


def _entries(t: pa.Table, payloads: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    n = t.column("n").to_numpy()
    keys = np.concatenate([unpack_keys(raw, k) for raw, k in zip(t.column("keys").to_pylist(), n.tolist())])
    return n, keys, {c: np.concatenate([unpack_counts(raw, k) for raw, k in zip(t.column(c).to_pylist(), n.tolist())]) for c in payloads}


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each entry's number among them."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(new) - 1
    return keys[order][new], run


def messages(keys: np.ndarray, group: np.ndarray, *more: Callable[[int, int], object]) -> list[tuple]:
    """(group, entries, packed keys, ...) for each run of equal groups; keys are in order within one. more: made from a run's bounds."""
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
    return [(int(group[a]), int(b - a), pack_keys(keys[a:b]), *(f(a, b) for f in more)) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def resolve(asks: DataFrame, chunks: int, groups: int, payloads: list[str], reply: Callable, schema: str, kind_of: Callable[[int, int], tuple[int, int]]) -> DataFrame:
    """Replies (grp, chunk, ...: schema) to messages (grp, chunk, n, keys, payloads as packed counts).

    reply(numbers, n, held, distinct, above) -> columns with a value for each message: of all entries, in order,
    their key's number among the distinct ones; entries of each message; payloads of all entries; and None, or for
    a batch of chunks the replies to its merged messages, in the order of the distinct keys, and how many keys each has.
    Merged messages have the payloads' sums. kind_of(grp, groups): how many groups the keys' kind has, and its first.
    """
    from .common import cut

    names = [x.split()[0] for x in schema.split(", ")]

    def answered(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        n, keys, held = _entries(t, payloads)
        distinct, run = numbered(keys)
        return pa.table([t.column("grp"), t.column("chunk"), *reply(run, n, held, len(distinct), None)], names)

    if chunks <= FAN:
        return asks.groupBy("grp").applyInArrow(answered, schema)
    asks = cut(asks.withColumn("batch", F.floor(F.col("chunk") / FAN).cast("int")))
    finer, fan = -(-chunks // FAN), FAN

    def fine_groups(distinct: np.ndarray, grp: int) -> np.ndarray:
        share, first = kind_of(grp, groups)
        return key_group(distinct, share * finer) + first * finer

    def merged(t: pa.Table) -> pa.Table:
        _, keys, held = _entries(t, payloads)
        distinct, run = numbered(keys)
        sums = [np.bincount(run, weights=held[c], minlength=len(distinct)).astype(np.int64) for c in payloads]
        rows = messages(distinct, fine_groups(distinct, t.column("grp")[0].as_py()), *(lambda a, b, x=x: pack_counts(x[a:b]) for x in sums))
        cols = list(zip(*rows))
        batch = pa.array([t.column("batch")[0].as_py()] * len(rows), pa.int32())
        return pa.table([pa.array(cols[0], pa.int32()), batch, pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["grp", "chunk", "n", "keys", *payloads])

    up = asks.groupBy("grp", "batch").applyInArrow(merged, "grp int, chunk int, n int, keys binary" + "".join(f", {c} binary" for c in payloads))
    down = resolve(up, -(-chunks // fan), groups * finer, payloads, reply, schema, kind_of)
    down = down.withColumnsRenamed({"grp": "fine", "chunk": "batch"}).withColumn("grp", F.floor(F.col("fine") / finer).cast("int"))

    def expanded(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        n, keys, held = _entries(t, payloads)
        distinct, run = numbered(keys)
        sizes = np.unique(fine_groups(distinct, t.column("grp")[0].as_py()), return_counts=True)[1]
        return pa.table([t.column("grp"), t.column("chunk"), *reply(run, n, held, len(distinct), (replies.sort_by("fine"), sizes))], names)

    return asks.groupBy("grp", "batch").cogroup(down.groupBy("grp", "batch")).applyInArrow(expanded, schema)
