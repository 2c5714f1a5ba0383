"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, unchanged; a text of fewer words
is one shingle); two texts are linked if their sets' Jaccard similarity is 0.8 or more.

1. Equal sets are one class; the class's least doc_id stands for it from here on.
2. Candidates: a set's MinHash values in BANDS bands of ROWS; sets that share a band are linked to the
   band's least doc_id, and the connected components of these links are the candidate groups. A pair
   at 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, below 1e-5.
   Bands also chain sets of half that similarity into groups that grow with the data. A group of more
   than CUT_BLOCKS blocks is therefore cut up first: its sets' MinHash values (no texts) meet band by band,
   each pair in the first band that it shares, those that the pruning below drops link nothing, and
   what stays connected is a group.
3. A group's members go, with their texts, to the tasks of pairs of blocks (a block has about
   BLOCK_DOCS sets or BLOCK_TEXT bytes of text), so that a large group is spread over many tasks and
   no pair becomes a row. There MinHash values are compared 30 at a time, and a pair is dropped once
   the posterior probability (uniform prior) that it reaches the threshold is below TOLERANCE.
4. Pairs that stay are verified on their whole sets of 64-bit shingle fingerprints. Out come each
   set's number of linked documents and a spanning forest of the links, from which the final groups are.

The result has one row per input row: doc_id, class_id (the least doc_id of its group of linked
documents), n_links (linked documents, copies counted), copies (rows with an equal set). Texts without
words (null and empty ones) have no shingles and no links: each is its own class. Rows that repeat a
doc_id and text get equal results, and count as copies. A row without doc_id gets the class of equal
texts, else a null class_id; it stands for no class. Where one doc_id is on rows with different texts,
each set goes its own way: a set's key is its digest, and groups that have one least doc_id stay apart
though their class_id is the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import words as W
from .components import by_hot_key, components

WORDS, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 30, 5, 30, 1e-7
BLOCK_DOCS, BLOCK_TEXT, BLOCK_SKETCHES, CUT_BLOCKS = 1024, 6 << 20, 1024, 8


def _hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = W.mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[k:] >> np.uint64(32)).astype(np.uint32)


_A, _B = _hash_family(BANDS * ROWS)


def shingles(b: W.Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of each text, sorted by text and fingerprint, and bounds by text."""
    h = W.word_hashes(b)
    gs = W.gram_starts(b, n)
    g, d = W.gram_hashes(h, n)[gs] if len(gs) else np.empty(0, np.uint64), b.doc[gs]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < n))
    if len(short):
        x = np.array([int(W.mix(np.array([sum(int(v) * (2 * j + 3) for j, v in enumerate(h[b.first[s] : b.first[s + 1]])) + len(h[b.first[s] : b.first[s + 1]]) & (1 << 64) - 1], np.uint64))[0]) for s in short.tolist()], np.uint64)
        g, d = np.concatenate([g, x]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(b.n_docs + 1))


def minhashes(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BANDS x ROWS values for each non-empty set."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(some), len(_A)), np.uint32)
    x = (g >> np.uint64(17)).astype(np.uint32)
    at = bounds[:-1][some]
    for k in range(len(_A)):
        y = x * _A[k]
        y += _B[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, at) if len(at) else 0
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A number for each band of each row of MinHash values; other bands have other numbers."""
    keys = np.empty((len(m), BANDS), np.uint64)
    for k in range(BANDS):
        x = np.full(len(m), k + 1, np.uint64)
        for j in range(k * ROWS, (k + 1) * ROWS):
            x = W.mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
        keys[:, k] = x
    return keys


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest (binary, null for an empty set), bands (array of long), same (a hash that tells texts of one doc_id apart)."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        g, bounds = shingles(W.split(block.column(1)))
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        m = minhashes(g, bounds)
        keys = band_keys(m)
        at = bounds[:-1][some]
        two = [np.add.reduceat(W.mix(g ^ np.uint64(s)), at) if len(at) else np.empty(0, np.uint64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        digest: list[bytes | None] = [None] * len(n)
        for d, x, y in zip(some.tolist(), two[0].tolist(), two[1].tolist()):
            digest[d] = x.to_bytes(8, "little") + y.to_bytes(8, "little")
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(digest, pa.binary()), bands, block.column(2)], ["doc_id", "digest", "bands", "same"])

    return C.map_blocks(C.documents(docs).withColumn("same", F.xxhash64("text")), fn, "doc_id long, digest binary, bands array<long>, same long")


def least_matches(t: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer the posterior probability of similarity t or more, P(Bin(n + 1, t) <= m), is below the tolerance."""
    out = []
    for n in range(STEP, len(_A) + 1, STEP):
        p, m = 0.0, 0
        while True:
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _verify(g: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of sets reach t exactly: a product of 0/1 matrices over the shingles that two sets or more have."""
    if not len(i):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([i, j]))
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(used)), n[used])
    vals = np.concatenate([g[bounds[d] : bounds[d + 1]] for d in used.tolist()])
    order = np.argsort(vals, kind="stable")
    rows, vals = rows[order], vals[order]
    new = np.concatenate([[True], vals[1:] != vals[:-1]])
    col = np.cumsum(new) - 1
    many = np.bincount(col) > 1
    keep = many[col]
    rows, col = rows[keep], (np.cumsum(many) - 1)[col[keep]]
    ii, jj = np.searchsorted(used, i), np.searchsorted(used, j)
    if len(i) <= 4 * len(used) or len(used) < 64:  # few pairs: count what each shares
        both = np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            both[k] = len(np.intersect1d(g[bounds[a] : bounds[a + 1]], g[bounds[b] : bounds[b + 1]], assume_unique=True))
    else:
        wide, common = 2048, np.zeros((len(used), len(used)), np.float32)
        cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else 0) + wide + 1, wide))
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                m = np.zeros((len(used), wide), np.float32)
                m[rows[a:b], col[a:b] - c * wide] = 1
                common += m @ m.T
        both = common[ii, jj].astype(np.int64)
    # |A & B| / |A | B| >= t without rounding: t in thousandths
    return 1000 * both >= round(1000 * t) * (n[i] + n[j] - both)


def _stays(m: np.ndarray, i: np.ndarray, j: np.ndarray, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of MinHash values that the posterior does not drop."""
    same = np.zeros(len(i), np.int64)
    for stop, least in rules:
        same += (m[i, stop - STEP : stop] == m[j, stop - STEP : stop]).sum(1)
        stay = same >= least
        i, j, same = i[stay], j[stay], same[stay]
    return i, j


def _links(parts: list[tuple[int, int, np.ndarray | None]], col: pa.ChunkedArray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (indices) of the parts of a column of texts: among a part's texts or, with a mask, between those in it and the others."""
    g, bounds = shingles(W.split(col))
    m = np.zeros((len(bounds) - 1, len(_A)), np.uint32)
    n = np.diff(bounds)
    m[n > 0] = minhashes(g, bounds)
    rules, thousandths = least_matches(t), round(1000 * t)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def prune() -> None:
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        found.append(_stays(m, i, j, rules))

    for start, stop, mask in parts:
        idx = np.arange(start, stop)
        one, two = (idx, idx) if mask is None else (idx[mask], idx[~mask])
        for s in range(0, len(one), 32):
            a = one[s : s + 32]
            # sets whose sizes differ too much cannot reach t
            fits = (1000 * n[a][:, None] >= thousandths * n[two][None]) & (1000 * n[two][None] >= thousandths * n[a][:, None])
            i, j = np.nonzero(fits & (two[None] > a[:, None]) if mask is None else fits)
            held.append((a[i], two[j]))
            if sum(len(x[0]) for x in held) > 1 << 15:
                prune()
    if held:
        prune()
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    part = np.searchsorted([p[1] for p in parts], i, side="right")
    order = np.argsort(part, kind="stable")
    i, j, part = i[order], j[order], part[order]
    cuts = np.searchsorted(part, np.arange(len(parts) + 1))
    ok = [_verify(g, bounds, i[x:y], j[x:y], t) for x, y in zip(cuts, cuts[1:])]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def _forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each text the least id that its links reach."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (places of representatives) after the links between i and j."""
    up = np.arange(len(label))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    for x, y in np.unique(np.stack([label[i], label[j]], 1), axis=0).tolist():
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up = up[up]
    return up[label]


def _blocks(df: DataFrame, by: list[str], key: str, blocks: str) -> DataFrame:
    """df dealt, for each pair of its groups' blocks (low <= high), to one place; own: a row's block."""
    d = df.withColumn("own", F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    d = d.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", blocks)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return d.repartition(n, *by, "low", "high").sortWithinPartitions(*by, "low", "high")


def _cut_up(text: DataFrame, threshold: float) -> DataFrame:
    """doc_id and its new component, for sets (doc_id, text) of groups of many blocks; sets that no pair keeps are left out."""

    def sketched(block: pa.RecordBatch) -> pa.RecordBatch:
        g, bounds = shingles(W.split(block.column(1)))
        m = minhashes(g, bounds)
        keys, ids = band_keys(m), block.column(0).to_numpy()[np.diff(bounds) > 0]
        rows = np.repeat(np.arange(len(m)), BANDS)
        values = pa.array([x.tobytes() for x in m], pa.binary()).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(keys.ravel().view(np.int64)), values], ["doc_id", "band", "values"])

    s = C.cut(C.map_blocks(text.select("doc_id", "text"), sketched, "doc_id long, band long, values binary"))
    many = C.cut(s.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_SKETCHES).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1"))
    dealt = _blocks(by_hot_key(s, many, "band", "n", C.counted(s)).drop("n"), ["band"], "doc_id", "blocks")
    rules = least_matches(threshold)

    def linked(batches):
        for (band, low, high), t in C.grouped(batches, ["band", "low", "high"]):
            ids, own = t.column("doc_id").to_numpy(), t.column("own").to_numpy()
            m = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint32).reshape(len(t), -1)
            keys = band_keys(m)
            at = int(np.flatnonzero(keys[0] == np.int64(band).astype(np.uint64))[0])
            i, j = (np.flatnonzero(own == x) for x in (low, high))
            label = np.arange(len(ids))
            for k in range(0, len(i), 64):
                a, b = (x.ravel() for x in np.meshgrid(i[k : k + 64], j, indexing="ij"))
                on = label[a] != label[b]  # a pair that is connected already needs no other link
                a, b = a[on], b[on]
                if low == high:
                    a, b = a[a < b], b[a < b]
                first = ~(keys[a, :at] == keys[b, :at]).any(1)  # the pair meets in the first band that it shares
                label = _merged(label, *_stays(m, a[first], b[first], rules))
            some = label != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], ["u", "v"])

    return components(C.arrow(dealt.select("band", "low", "high", "own", "doc_id", "values"), linked, "u long, v long"))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, digest, same, class_id, n_links, copies, and whether the row's set has the class's least doc_id (chief)."""
    docs = C.documents(docs)
    s = C.cut(sketch(docs))
    sets = C.cut(s.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # a set's node is its least doc_id, but where sets have one in common all nodes are numbers of their own
    shared = bool(C.taken(sets.groupBy("rep").count().where("count > 1").limit(1)))
    sets = C.cut(sets.withColumn("node", F.monotonically_increasing_id())) if shared else sets.withColumn("node", F.col("rep"))
    reps = s.join(sets.withColumnRenamed("digest", "_digest"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("_digest"))).dropDuplicates(["node"]).select("node", "rep", "copies", "bands", "same")
    band = reps.select("node", F.explode("bands").alias("band"))
    least = band.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = components(band.join(least, "band").where("node != v").select(F.col("node").alias("u"), "v"))

    members = C.cut(near.withColumnRenamed("node", "_node").join(reps.select("node", "rep", "copies", "same"), F.col("_node") == F.col("node")).select("component", "node", "rep", "copies", "same"))
    # of equal rows one, and of a doc_id's texts the set's
    text = docs.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").where(F.xxhash64("text") == F.col("same")).groupBy("node", "component", "copies").agg(F.min("text").alias("text"))
    text = C.cut(text.withColumnRenamed("node", "doc_id"))
    size = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_TEXT), F.lit(1)).cast("int").alias("blocks")
    blocks = C.cut(text.groupBy("component").agg(size, F.count("*").alias("n")))
    total = C.counted(text)
    sized = by_hot_key(text, blocks, "component", "n", total).drop("n")
    if C.taken(blocks.where(F.col("blocks") > CUT_BLOCKS).limit(1)):
        large = C.cut(sized.where(F.col("blocks") > CUT_BLOCKS).drop("blocks"))
        part = _cut_up(large, threshold).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "_part")
        large = C.cut(large.join(part, "doc_id").drop("component").withColumnRenamed("_part", "component"))
        again = C.cut(large.groupBy("component").agg(size, F.count("*").alias("n")))
        sized = sized.where(F.col("blocks") <= CUT_BLOCKS).unionByName(by_hot_key(large, again, "component", "n", total).drop("n"))
    dealt = _blocks(sized.select("component", "doc_id", "copies", "text", "blocks"), ["component"], "doc_id", "blocks")

    def pairs(batches):
        held: list[tuple[tuple, pa.Table]] = []

        def links():
            t = pa.concat_tables([x for _, x in held])
            ids, copies, own = (t.column(c).to_numpy() for c in ("doc_id", "copies", "own"))
            parts, at = [], 0
            for (_, low, high), x in held:
                mask = own[at : at + len(x)] == low if high > low else None
                if mask is None or mask.any() and not mask.all():
                    parts.append((at, at + len(x), mask))
                at += len(x)
            held.clear()
            i, j = _links(parts, t.column("text"), threshold)
            n = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(_forest(i, j, ids)[some])], ["rep", "links", "root"])

        for x in C.grouped(batches, ["component", "low", "high"]):  # small groups are compared together
            held.append(x)
            if sum(t.num_rows for _, t in held) >= 512 or sum(t.nbytes for _, t in held) >= C.BLOCK_BYTES:
                yield links()
        if held:
            yield links()

    linked = C.cut(C.arrow(dealt, pairs, "rep long, links long, root long").withColumnRenamed("rep", "node"))
    final = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    of_rep = sets.join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(final, "node", "left")
    if shared:
        heads = final.join(sets.select("node", "rep"), "node").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head"))
        of_rep = of_rep.join(heads, "component", "left")
        class_id, chief = F.coalesce("head.rep", "rep"), F.coalesce(F.col("head.node") == F.col("node"), F.lit(True))
    else:
        class_id, chief = F.coalesce("component", "rep"), F.lit(True)
    of_set = C.cut(of_rep.select("digest", "copies", class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), chief.alias("chief")))
    of_row = by_hot_key(s.select("doc_id", "digest", "same"), of_set, "digest", "copies", C.counted(s), "left")
    return of_row.select(
        "doc_id", "digest", "same", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("chief", F.lit(True)).alias("chief")
    )


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return _classes(docs, threshold).select("doc_id", "class_id", "n_links", "copies")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row of each class, one with the class's doc_id, with all columns. Equal rows stay once; rows without doc_id all stay."""
    mark = "_same"
    while mark in docs.columns:
        mark = f"_{mark}"
    kept = _classes(docs.where("doc_id is not null"), threshold).where("doc_id = class_id and chief").groupBy("doc_id", "digest").agg(F.min("same").alias(mark)).select("doc_id", mark)
    one = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
