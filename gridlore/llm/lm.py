"""Deleted interpolation: bigram, unigram and uniform estimates mixed by buckets of context frequency.

P(w | v) = a[b] c(v w) / c(v) + u[b] c(w) / N + z[b] / (V + 1), with b the bucket of c(v) (0 for an
unseen context, else 1 + floor(log2 c(v)) up to BUCKETS - 1) and weights that sum to 1. Counts are of
all training documents; the weights are learned by expectation-maximisation on the bigrams of a
held-out part of them (one document in FOLDS, by crc32 of its id), whose probabilities come from the
counts of the other part. A document's first context is its start; its last token is its end.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Counts are gathered from all documents
by the chunk exchange, nothing about words goes to the driver: it gets N, V, the number of training
documents, and the held-out bigrams summed into a bounded grid of (bucket, log ratios).

Null and empty texts have their end as only token. With no training document the model is uniform
and N is 0. Rows that repeat a doc_id are documents of their own; a null doc_id counts as 0; other columns
are not looked at. The packed counts are written to the shared folder (a table lm-..., which may go once the
scores are written), so that a lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import common as C
from . import exchange as X
from . import words as W

FOLDS, BUCKETS, GRID = 8, 24, 8
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6C62272E07BB0142)


def _tokens(t: pa.Table):
    """Token fingerprints of a chunk's texts with each end, contexts, text numbers, and first tokens of texts."""
    h, doc = X.chunk_words(t.column("text"), W.SPACED, True)
    n = np.bincount(doc, minlength=len(t)) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.empty(first[-1], np.uint64)
    ends = np.zeros(first[-1], bool)
    ends[first[1:] - 1] = True
    token[~ends] = h
    token[ends] = _END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = _START
    return token, before, np.repeat(np.arange(len(t)), n), first


def _keys(token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return W.mix(token) & X.KEY, W.mix(W.mix(before) * np.uint64(0x9E3779B97F4A7C15) + token) & X.KEY


def _folds(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text trains, and whether it is of the part that the weights are learned on."""
    crc = t.column("crc").to_numpy()
    trains = crc % 7 != 2
    return trains, trains & (crc // 7 % FOLDS == 0)


def _kind(grp: int, groups: int) -> tuple[int, int]:
    """Bigrams have the first groups (a multiple of four), unigrams a quarter as many after them."""
    return (groups, 0) if grp < groups else (groups // 4, groups)


def _group(keys: np.ndarray, groups: int, kind: int) -> np.ndarray:
    share, first = _kind(0 if kind else groups, groups)
    return X.key_group(keys, share) + first


def counts(docs: DataFrame) -> DataFrame:
    """A row for each document: what its score needs from the corpus, as packed counts."""
    spark = docs.sparkSession
    ship(spark)
    plan = X.layout(docs)
    groups = 4 * -(-plan.groups // 4)
    crc = F.crc32(F.coalesce("doc_id", F.lit(0)).cast("string").cast("binary")).alias("crc")
    parts = X.chunked(docs, plan, crc)

    def ask(t: pa.Table) -> pa.Table:
        token, before, doc, _ = _tokens(t)
        trains, held = _folds(t)
        rows = []
        for kind, keys in enumerate(_keys(token, before)):
            order, new, group = X.by_group(keys, _group(keys, groups, kind))
            # train (all but the held-out part), held-out part
            sums = [np.add.reduceat(x[doc[order]].astype(np.int64), new) if len(new) else np.empty(0, np.int64) for x in (trains & ~held, held)]
            rows += X.messages(keys[order][new], group, *(lambda a, b, s=s: X.pack_counts(s[a:b]) for s in sums))
        cols = list(zip(*rows)) or [()] * 5
        chunk = t.column("chunk")[0].as_py() if len(t) else 0
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([chunk] * len(rows), pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["grp", "chunk", "n", "keys", "train", "held"])

    def reply(run, n, own, distinct, above):
        """Counts of all training documents for each entry, and for one message of each key that there is one more."""
        ends = np.cumsum(n)
        part = [(e - k, e) for e, k in zip(ends.tolist(), n.tolist())]
        if above is None:
            total = [np.bincount(run, weights=own[c], minlength=distinct).astype(np.int64) for c in ("train", "held")]
            first = np.full(distinct, -1)
            first[run[::-1]] = np.arange(len(run))[::-1]  # of each key the entry of one message counts it
            counts = np.zeros(len(run), bool)
            counts[first] = total[0] + total[1] > 0
            new = [int(counts[a:b].sum()) for a, b in part]
        else:
            replies, sizes = above
            total = [np.concatenate([X.unpack_counts(raw, k) for raw, k in zip(replies.column(c).to_pylist(), sizes.tolist())]) for c in ("train", "held")]
            new = [sum(replies.column("distinct").to_pylist())] + [0] * (len(n) - 1)
        return [*(pa.array([X.pack_counts(x[run[a:b]]) for a, b in part], pa.binary()) for x in total), pa.array(new, pa.int64())]

    def apply(t: pa.Table, replies: pa.Table) -> pa.Table:
        token, before, doc, first = _tokens(t)
        trains, held = _folds(t)
        uni, bi = _keys(token, before)
        found, distinct = [], 0
        answers = {g: k for k, g in enumerate(replies.column("grp").to_pylist())}
        columns = {c: replies.column(c).to_pylist() for c in ("train", "held", "distinct")}
        for kind, keys in enumerate((uni, bi)):
            order, new, group = X.by_group(keys, _group(keys, groups, kind))
            each = [np.empty(len(new), np.int64) for _ in range(2)]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                k = answers[int(group[a])]
                for x, c in zip(each, ("train", "held")):
                    x[a:b] = X.unpack_counts(columns[c][k], b - a)
                distinct += columns["distinct"][k] if kind == 0 else 0
            run = np.cumsum(np.bincount(new, minlength=len(order))) - 1
            for x in each:
                y = np.empty(len(keys), np.int64)
                y[order] = x[run]
                found.append(y)
        train_w, held_w, train_vw, held_vw = found
        n_docs = len(t)
        pack = lambda x, on: [X.pack_counts(x[first[d] : first[d + 1]]) if on[d] else None for d in range(n_docs)]
        all_on = np.ones(n_docs, bool)
        cols = {
            "doc_id": t.column("doc_id").combine_chunks(), "trains": pa.array(trains), "n_tokens": pa.array(np.diff(first)),
            "w": pa.array(pack(train_w + held_w, all_on), pa.binary()), "vw": pa.array(pack(train_vw + held_vw, all_on), pa.binary()),
            "held_w": pa.array(pack(train_w, held), pa.binary()), "held_vw": pa.array(pack(train_vw, held), pa.binary()),
            "distinct": pa.array(np.concatenate([[distinct], np.zeros(n_docs - 1, np.int64)]) if n_docs else np.empty(0, np.int64)),
        }
        return pa.table(cols)

    asks = parts.groupBy("chunk").applyInArrow(ask, "grp int, chunk int, n int, keys binary, train binary, held binary")
    replies = X.resolve(asks, plan.chunks, groups, ["train", "held"], reply, "grp int, chunk int, train binary, held binary, distinct long", _kind)
    return parts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(apply, "doc_id long, trains boolean, n_tokens long, w binary, vw binary, held_w binary, held_vw binary, distinct long")


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), BUCKETS - 1), 0)


def _contexts(w: np.ndarray, starts: int) -> np.ndarray:
    """A token's context occurs as often as the token before it; the first one's as often as texts start."""
    return np.concatenate([[starts], w[:-1]])


def grid_cells(w: np.ndarray, vw: np.ndarray, starts: int, total: int, uniform: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, log2 of bigram, of unigram over uniform) for each token; GRID cells to a doubling, absent counts at -1."""
    v = _contexts(w, starts)
    b = bucket(v)
    big = np.log2(np.maximum(vw, 0.5) / np.maximum(v, 1) / uniform)
    one = np.log2(np.maximum(w, 0.5) / max(total, 1) / uniform)
    x = np.where(vw > 0, np.clip(np.floor(big * GRID), -64 * GRID, 64 * GRID - 1) + 64 * GRID, -1).astype(np.int64)
    y = np.where(w > 0, np.clip(np.floor(one * GRID), -64 * GRID, 64 * GRID - 1) + 64 * GRID, -1).astype(np.int64)
    return (b << 24) | (x + 1 << 12) | (y + 1), big, one


def learn(cells: list[tuple[int, int, float, float]], rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation. cells: (cell, tokens, sum of big, sum of one)."""
    weights = np.tile([0.5, 0.3, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.6, 0.4]
    if not cells:
        return weights
    c = np.array([(x[0], x[1], x[2] / x[1], x[3] / x[1]) for x in cells], float)
    code = c[:, 0].astype(np.int64)
    b, n = code >> 24, c[:, 1]
    p = np.stack([np.where((code >> 12 & 4095) > 0, np.exp2(c[:, 2]), 0), np.where((code & 4095) > 0, np.exp2(c[:, 3]), 0), np.ones(len(c))], 1)
    for _ in range(rounds):
        share = p * weights[b]
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], 1)
        seen = sums.sum(1) > 0
        # the least weight keeps every text possible
        weights[seen] = np.maximum(sums[seen] / sums[seen].sum(1, keepdims=True), [0, 0, 1e-9])
        weights[seen] /= weights[seen].sum(1, keepdims=True)
    return weights


def probabilities(w: np.ndarray, vw: np.ndarray, starts: int, total: int, distinct: int, weights: np.ndarray) -> np.ndarray:
    v = _contexts(w, starts)
    a = weights[bucket(v)]
    return a[:, 0] * vw / np.maximum(v, 1) + a[:, 1] * w / max(total, 1) + a[:, 2] / (distinct + 1)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    place = f"{C.shared_dir(spark)}/lm-{C.unique()}"
    counts(C.documents(docs)).write.option("compression", "zstd").parquet(place)
    t = spark.read.parquet(place)
    s = t.agg(F.sum(F.when(F.col("trains"), F.col("n_tokens"))).alias("n"), F.sum("distinct").alias("v"), F.sum(F.col("trains").cast("long")).alias("d"), F.sum(F.when(F.col("held_w").isNotNull(), F.col("n_tokens"))).alias("hn"), F.count("held_w").alias("hd")).first()
    total, distinct, starts = s.n or 0, s.v or 0, s.d or 0
    part, part_starts = total - (s.hn or 0), starts - (s.hd or 0)
    uniform = 1 / (distinct + 1)

    def cells(batches):
        for batch in batches:
            out: dict[int, list[float]] = {}
            found = [grid_cells(X.unpack_counts(w, n), X.unpack_counts(vw, n), part_starts, part, uniform) for n, w, vw in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            if found:
                code, big, one = (np.concatenate(x) for x in zip(*found))
                cell, at = np.unique(code, return_inverse=True)
                out = [pa.array(cell), pa.array(np.bincount(at).astype(np.int64)), pa.array(np.bincount(at, weights=big)), pa.array(np.bincount(at, weights=one))]
                yield pa.RecordBatch.from_arrays(out, ["cell", "n", "big", "one"])

    grid = C.arrow(t.where("held_w is not null").select("n_tokens", "held_w", "held_vw"), cells, "cell long, n long, big double, one double")
    weights = learn([tuple(r) for r in grid.groupBy("cell").agg(F.sum("n"), F.sum("big"), F.sum("one")).orderBy("cell").collect()])  # a bounded grid
    base_log = math.log10(total + distinct + 1)

    def score(batches):
        for batch in batches:
            known, base, own = [], [], []
            for n, w, vw in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                w, vw = X.unpack_counts(w, n), X.unpack_counts(vw, n)
                known.append(int((w > 0).sum()))
                base.append(float(np.log10(w + 1.0).sum() - n * base_log))
                own.append(float(np.log10(probabilities(w, vw, starts, total, distinct, weights)).sum()))
            held = pa.array([not x for x in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, batch.column(2), pa.array(known, pa.int64()), pa.array([total] * len(known), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return C.arrow(t.select("doc_id", "trains", "n_tokens", "w", "vw"), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
