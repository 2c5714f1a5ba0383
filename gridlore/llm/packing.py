"""Best-fit packing by length patterns that non-negative least squares fits to the histogram of lengths.

1. Texts become token ids and an end id; pieces are the full sequences at a text's end and a shorter
   first one. Only (doc_id, piece, start, length, checksum) go on.
2. The histogram of lengths (as many numbers as a sequence has tokens) goes to the driver. Patterns of
   one to four lengths that fill a sequence are enumerated from it (a short length may stand in one many
   times, beside two others at most); projected gradients fit repeat
   counts x >= 0 that minimise the squared difference between the patterns' lengths and the histogram;
   they are rounded down and held to what is there. Lengths that no such pattern holds are fitted by
   the patterns that leave least, unless best fit alone needs fewer sequences. What is left is packed
   best fit first, longest length first, over groups of equal sequences.
3. The plan is a table of (length, first rank, count, sequence, offset), its size bounded by the number
   of patterns and lengths and not by the rows. Each piece's rank among those of its length comes from
   counts by (length, salt), with a salt for every SALT_ROWS pieces of a length, so that a length that
   most rows share is ranked in many tasks. Salts are drawn by row, not by id.

Null and empty texts are one piece, the end id. Rows that are equal or repeat a doc_id (or have none)
each get a place. An empty table packs to an empty one. The pieces are checkpointed: a lost executor
costs the tasks that it ran, not the tokens of other ones.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEQUENCE, END_ID = 1024, 2
#: Pieces of one length that are ranked together, and salts at most.
SALT_ROWS, SALTS = 500, 100_000
#: Tokens that a pattern leaves free at most; lengths that no such pattern holds are fitted by those that leave least.
SLACK = 0
#: The shortest lengths, up to this share of all tokens, fill gaps better than patterns: how much of them the fit may use is tried in turn, until no more sequences are needed than the tokens fill.
SHORT, SHARES = 0.02, (1.0, 0.5, 0.1, 0.0)


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary, read as ranks.

    byte_bpe_50k.json of the tokenizers library and byte_bpe_50k.tiktoken hold one vocabulary and one
    pretokenizer, so that the ids are equal (tests compare them); the second is two to three times as
    fast, and what the first takes for a special token in a text is one here too.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.core.encode_to_numpy(t or "", allowed_special="all") for t in texts]


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    state: dict = {}

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            import public_tokenizers

            state[0] = Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        rows: list[tuple] = []
        for doc, ids in zip(block.column(0).to_pylist(), state[0](block.column(1).to_pylist())):
            raw = ids.tobytes() + end_id.to_bytes(4, "little")
            n = len(raw) // 4
            cuts = [0, *range(n - (n - 1) // size * size, n + 1, size)]
            rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return C.map_blocks(C.documents(docs), fn, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, wide: int = 6) -> list[tuple[int, ...]]:
    """Tuples of lengths, longest first, that fill a sequence or leave as little as the histogram's lengths allow; at most about 5 for each length and `wide`."""
    size, there = len(hist) - 1, np.flatnonzero(hist)
    out: set[tuple[int, ...]] = set()
    if not len(there):
        return []
    common = there[np.argsort(-hist[there], kind="stable")]
    fit = lambda room: int(there[k - 1]) if (k := np.searchsorted(there, room, side="right")) else 0  # noqa: E731  the longest length that fits
    for a in there.tolist():
        out.add((a,) * max(1, min(4, size // a)))
        if b := fit(size - a):
            out.add(tuple(sorted((a, b), reverse=True)))
        for b in common[common <= size - a][:wide].tolist():
            room = size - a - b
            if c := fit(room):
                out.add(tuple(sorted((a, b, c), reverse=True)))
                if d := fit(room - c):
                    out.add(tuple(sorted((a, b, c, d), reverse=True)))
        for r in {size // a, size // a - 1, size // a - 2, size // (2 * a)} if 5 * a <= size else ():
            room = size - r * a
            out.add((a,) * r)
            for b in {fit(room), fit(room // 2), *common[common <= room][:wide].tolist()} - {0}:
                c = fit(room - b)
                out.add(tuple(sorted((a,) * r + (b, c) * bool(c) + (b,) * (not c), reverse=True)))
        half = (size - a) // 2
        for b in (fit(half), fit(half * 2 // 3)):
            if b and (c := fit(size - a - b)):
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def fit_counts(pats: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with about the least squared difference between the patterns' lengths times x and the histogram (accelerated projected gradients)."""
    if not pats:
        return np.zeros(0)
    each = [Counter(p) for p in pats]
    width = max(map(len, each))
    idx, live = np.zeros((len(pats), width), np.int64), np.zeros((len(pats), width))  # distinct lengths (0: none) and how often they stand there
    for k, c in enumerate(each):
        idx[k, : len(c)], live[k, : len(c)] = list(c), list(c.values())
    target = hist.astype(float).copy()
    target[0] = 0

    def ahead(x: np.ndarray) -> np.ndarray:
        y = np.bincount(idx.ravel(), weights=(live * x[:, None]).ravel(), minlength=len(hist))
        y[0] = 0
        return y

    v = np.ones(len(pats))
    for _ in range(30):  # the largest eigenvalue of A^T A
        w = (ahead(v)[idx] * live).sum(1)
        top = np.linalg.norm(w)
        v = w / top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - ((ahead(y) - target)[idx] * live).sum(1) / top)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths, how many sequences) that best fit makes of the histogram, longest length first."""
    size = len(hist) - 1
    room: dict[int, list[list]] = defaultdict(list)
    open_rooms: set[int] = set()
    for n in range(size, 0, -1):
        left = int(hist[n])
        while left:
            r = min((r for r in open_rooms if r >= n), default=None)
            if r is None:
                q = size // n
                for k, c in ((q, left // q), (left % q, 1)):
                    if k and c:
                        room[size - k * n].append([(n,) * k, c])
                        open_rooms.add(size - k * n)
                left = 0
                continue
            group = room[r][-1]
            k = min(left, group[1])
            group[1] -= k
            if not group[1]:
                room[r].pop()
                if not room[r]:
                    open_rooms.discard(r)
            room[r - n].append([(*group[0], n), k])
            open_rooms.add(r - n)
            left -= k
    return [(g, c) for groups in room.values() for g, c in groups if c]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences that hold the histogram's lengths: fitted patterns, then best fit for the rest.

    Best fit needs short lengths to fill gaps with: of SHARES the one with the fewest sequences is taken.
    """
    left, out = hist.astype(np.int64).copy(), []
    size = len(hist) - 1
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    tokens = left * np.arange(size + 1)
    short, found, fewest = np.cumsum(tokens) <= SHORT * tokens.sum(), [], -(-int(tokens.sum()) // size)
    for share in SHARES:
        found.append(_packed(left, np.where(short, np.floor(left * share).astype(np.int64), left)))
        if sum(c for _, c in found[-1]) <= fewest:
            break
    return out + min(found, key=lambda groups: sum(c for _, c in groups))


def _packed(hist: np.ndarray, fitting: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns over the lengths `fitting`, then best fit for what they don't hold of all."""
    size, kept, part = len(hist) - 1, hist - fitting, fitting.copy()
    pats = [p for p in patterns(part) if size - sum(p) <= SLACK]
    out = _fitted(pats, part)
    held = {n for p in pats for n in p}
    bare = np.where(np.isin(np.arange(size + 1), list(held)), 0, part)
    plain = best_fit(part + kept)
    if not bare.any():
        return out + plain
    # of each length the patterns that leave least, if nothing there would go into what they leave
    free, shortest = {p: size - sum(p) for p in patterns(bare)}, int(np.flatnonzero(part + kept)[0])
    least: dict[int, int] = {}
    for p, f in free.items():
        for n in p:
            least[n] = min(f, least.get(n, size))
    more = _fitted([p for p, f in free.items() if f < shortest and any(f == least[n] for n in p)], part)
    more += best_fit(part + kept)
    return out + (more if sum(c for _, c in more) <= sum(c for _, c in plain) else plain)


def _fitted(pats: list[tuple[int, ...]], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Groups of the patterns at their fitted counts; what they hold is taken from left.

    A fit over many patterns gives most of them a part of a sequence, which rounding takes away. So the fit is
    made again over those of the largest counts, in the end no more than there are lengths (as a solution at a
    vertex would have).
    """
    out, counts, lengths = [], fit_counts(pats, left), int((left > 0).sum())
    while len(pats) > lengths:
        most = np.argsort(-counts, kind="stable")[: max(lengths, len(pats) // 2)]
        pats = [pats[k] for k in np.sort(most).tolist()]
        counts = fit_counts(pats, left)
    for k in np.argsort(-counts, kind="stable").tolist() if pats else []:
        need = Counter(pats[k])
        c = min(int(counts[k]), *(int(left[n]) // m for n, m in need.items()))
        if c > 0:
            out.append((pats[k], c))
            for n, m in need.items():
                left[n] -= c * m
    return out


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: first rank, first sequence, offset of each stretch of pieces, by first rank."""
    ranks, by, seq = defaultdict(int), defaultdict(list), 0
    for lengths, count in groups:
        offset = 0
        for n in lengths:
            by[n].append((ranks[n], seq, offset))
            ranks[n] += count
            offset += n
        seq += count
    return {n: np.array(x, np.int64) for n, x in by.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    p = C.cut(pieces(docs, path, size))
    hist = np.zeros(size + 1, np.int64)
    for r in p.groupBy("length").count().collect():  # at most `size` rows
        hist[r["length"]] = r["count"]
    where = spark.sparkContext.broadcast(slots(plan(hist)))
    most = max(SALT_ROWS, -(-int(hist.sum()) // SALTS))
    salts = F.array(*(F.lit(max(1, -(-int(n) // most))) for n in hist))
    salted = p.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts[F.col("length")]))  # p is checkpointed, so rows keep their numbers
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
        .join(F.broadcast(counts.withColumn("_before", before).drop("_n")), ["length", "_salt"])  # size + SALTS rows at most
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_k") - 1).alias("_rank"))
    )

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, bounds) if len(order) else []:
                t = where.value[int(length[rows[0]])]
                k = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                seq[rows] = t[k, 1] + rank[rows] - t[k, 0]
                off[rows] = t[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return C.arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
