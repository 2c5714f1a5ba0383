"""Filter interaction audit: what each filter removes at each place of each order, as products of incidence matrices.

1. A document's failures are a mask, one bit a filter. Which documents fail a filter by their text is
   found by array kernels, words told apart by 64-bit fingerprints; whether a text is that of a smaller
   doc_id comes from the least doc_id of each text's SHA-256, over counts that were summed by text before.
2. Of each part there are three histograms over masks (all documents, good ones, toxic ones), summed
   before they are shuffled, so that a part with most rows is no large task. A part has as many rows as
   there are masks at most.
3. Histograms are the rows of an integer matrix. It is multiplied by four 0-1 matrices of (masks) x
   (orders x steps): documents kept after a step, removed by it, redundant in it (failing its filter,
   removed earlier) and failing its filter alone. Removals, summed over orders and steps by filter, are
   its Shapley sum.

Null texts are empty; a null part is the empty string. A label holds for a doc_id if any of its rows
says 1, so that labels repeated, null or without a doc_id count once or not at all. Rows without a
doc_id have no labels, and neither are nor have copies; rows of one doc_id and text are no copies of each
other. An empty table has no parts and so no rows. Columns other than those named play no part. A
lost executor costs its tasks, as all steps are shuffles that Spark repeats.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import words as W

#: Rows without a doc_id are dealt over so many keys that no label has.
SPREAD = 1000
LETTERS = "ABCDEFGHIJ"
#: Bytes that are capitals, that are symbols, that are not the first of their code point.
CAPITALS, SYMBOLS, INNER = (~W.byte_table(set(of)) for of in (range(0x41, 0x5B), b"#$%&*|", range(0x80, 0xC0)))
#: The figures of a (part, order, step) that are products: name, histogram, matrix.
PRODUCTS = (("kept", 0, "kept"), ("removed", 0, "removed"), ("redundant", 0, "redundant"), ("unique_fails", 0, "unique"), ("good_lost", 1, "removed"), ("toxic_lost", 2, "removed"))


def text_rules(b: W.Block) -> list[np.ndarray]:
    """Which texts of a block fail filters A to D: few words, few distinct words, many capitals, symbols."""
    prints = W.word_hashes(b)
    order = np.lexsort((prints, b.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (prints[order][1:] != prints[order][:-1]) | (b.doc[1:] != b.doc[:-1])
    distinct = np.bincount(b.doc[fresh], minlength=b.n_docs)
    capitals, symbols, inner = (np.diff(np.searchsorted(np.flatnonzero(kind[b.data]), b.bounds)) for kind in (CAPITALS, SYMBOLS, INNER))
    return [b.n_words < 100, 100 * distinct < 80 * b.n_words, 100 * capitals > 10 * (np.diff(b.bounds) - inner), symbols > 0]


def incidence(n: int) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of n filters, and the matrices of (masks) x (orders x steps)."""
    orders = list(permutations(range(n)))
    masks = np.arange(1 << n)
    out = {k: np.zeros((1 << n, len(orders) * n), np.int64) for k in ("kept", "removed", "redundant", "unique")}
    for o, order in enumerate(orders):
        gone = np.zeros(1 << n, bool)
        for step, f in enumerate(order):
            col, fails = o * n + step, (masks >> f & 1) == 1
            out["removed"][:, col], out["redundant"][:, col], out["unique"][:, col] = fails & ~gone, fails & gone, masks == 1 << f
            gone |= fails
            out["kept"][:, col] = ~gone
    return ["".join(LETTERS[f] for f in order) for order in orders], out


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", rules=text_rules, n_rules: int = 4) -> DataFrame:
    """part, mask, n, n_good, n_toxic: documents of each part by the filters they fail; the last filter is for copies of a smaller doc_id's text."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        b = W.split(block.column(2))
        bits = sum(np.asarray(fails).astype(np.int32) << k for k, fails in enumerate(rules(b)))
        prints = [hashlib.sha256(b.data[x:y]).digest() for x, y in zip(b.bounds.tolist(), b.bounds[1:].tolist())]
        return pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(bits, pa.int32()), pa.array(prints, pa.binary())], names=["doc_id", "part", "mask", "print"])

    copy = 1 << n_rules
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = C.map_blocks(texts, fn, "doc_id long, part string, mask int, print binary").withColumn("spread", F.when(F.col("doc_id").isNull(), F.lit(1) + F.pmod(F.xxhash64("print"), F.lit(SPREAD))).otherwise(F.lit(0)))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    kinds = ["print", "part", "mask", "good", "toxic"]
    rows = slim.join(known, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"]).groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    groups = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    # a text has a group for each part and label at most; its rows are copies but for those of its least doc_id and those without one
    first = F.min("least.doc_id").over(Window.partitionBy("print"))
    own = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0) + F.col("loose")
    split = groups.withColumn("own", own).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("m"))
    return split.where("m.n > 0").groupBy("part", "m.mask").agg(F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("n_good"), F.sum(F.col("m.n") * F.col("toxic")).alias("n_toxic"))


def products(counts: DataFrame, n: int) -> DataFrame:
    """From masks of n filters: a row for each part, order and step."""
    hists = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("h"))  # 2^n at most
    names = [name for name, _, _ in PRODUCTS]

    def run(batches):
        orders, matrices = incidence(n)
        steps = len(orders) * n
        filters = np.array([LETTERS.index(f) for order in orders for f in order])
        for batch in batches:
            for part, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.zeros((3, 1 << n), np.int64)
                for m in h:
                    rows[:, m["mask"]] = m["n"], m["n_good"], m["n_toxic"]
                made = {k: rows @ matrix for k, matrix in matrices.items()}
                cols = [made[k][row] for _, row, k in PRODUCTS]
                shapley = np.array([made["removed"][0][filters == f].sum() for f in range(n)])[filters]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * steps, pa.string()), pa.array(np.repeat(orders, n), pa.string()), pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32()), *(pa.array(c, pa.int64()) for c in (*cols, shapley))], names=["part", "filter_order", "step", *names, "shapley"]
                )

    return C.arrow(hists, run, f"part string, filter_order string, step int, {', '.join(f'{x} long' for x in (*names, 'shapley'))}")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", rules=text_rules, n_rules: int = 4) -> DataFrame:
    """part, filter_order, step and the counts of documents of each. rules: which texts of a block fail each of n_rules filters, in the order of their letters; copies are the last filter."""
    return products(masks(docs, labels, part, rules, n_rules), n_rules + 1)
