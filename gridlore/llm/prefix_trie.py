"""The trie of conversations' common beginnings, by preorder intervals.

1. Each conversation's turns are numbered by a distributed running count (`scans`). In the query's
   rebuilding the first turns of a conversation are those of another one.
2. A turn is the first 128 bits of SHA-256 of its role and text. A beginning of d turns is told by its
   depth and by 128 bits: the running exclusive or of a hash of each turn with its depth, so that the
   parent's is at hand in every row. Equal conversations go on as one, with a count.
3. The different conversations are ranked lexicographically: blocks of FAN turns are ranked as arrays,
   then blocks of FAN ranks, until a conversation is one array; so the rounds grow with the logarithm of
   the longest conversation. A node's members are an interval of ranks, and nodes in order of (first
   rank, depth) stand in preorder.
4. Running sums over that order, of leaves and of savings, are taken once. A node's subtree ends with the
   last node that starts at its last member's rank; what the subtree holds is a difference of two sums.

A conversation with most turns, a beginning that most conversations share and a node with most children
are no large tasks: counts come first, and joins with few-row keys by `by_hot_key`. The digest of the
conversations that end in one node is one hash of a sequence, so it must be one task's; that task reads
ids joined by CHUNK beforehand, one after another, and holds one chunk.

Null roles and texts are empty. Rows without a conv_id belong to no conversation. Null turns come first;
equal turns are ordered by role, then by the first PREFIX characters of the text, then by digest, and
repeated rows are turns of their own. Other columns play no part. An empty table has no nodes, not even
a root. Steps are checkpointed: a lost executor costs tasks of the step it was lost in.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import by_hot_key
from .scans import running

#: Characters of role and text that order equal turns; turns or ranks of a block; ids of a chunk differ by less than 2^CHUNK.
PREFIX, FAN, CHUNK = 200, 64, 10
#: Conversations of a family, and one more than the turns that a rebuilt conversation has from its family's first at most.
FAMILY, SHARED = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, p (from 1), digest, words of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, PREFIX).alias("role"), F.substring(text, 1, PREFIX).alias("start"), F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    return running(turns, ["conv_id", "turn", "role", "start", "digest"], {"p": "one"}, "conv_id").select("conv_id", "p", "digest", "words")


def _shared(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest, words: the first h turns of the family's first conversation, then a conversation's own after its first h."""
    convs = turns.groupBy("conv_id").agg(F.max("p").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    info = convs.withColumn("donor", first).join(donors, "donor", "left").select("conv_id", "n", F.least(_shared(F.col("conv_id")), F.coalesce("donor_n", F.lit(0))).alias("given"))
    total = C.counted(turns)
    h = _shared(F.col("conv_id"))
    own = by_hot_key(turns.where((F.col("conv_id") == first) | (F.col("p") > h)), info, "conv_id", "n", total)
    own = own.select("conv_id", F.when(F.col("conv_id") == first, F.col("p")).otherwise(F.col("p") - h + F.col("given")).alias("depth"), "digest", "words")
    given = turns.where((F.col("conv_id") == first) & (F.col("p") < SHARED)).withColumnRenamed("conv_id", "donor")
    given = given.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.try_add(F.col("donor"), k.cast("long")))))
    given = given.where((F.col("conv_id") != F.col("donor")) & (first == F.col("donor")) & (F.col("p") <= h)).join(convs.select("conv_id"), "conv_id")
    return own.unionByName(given.select("conv_id", F.col("p").alias("depth"), "digest", "words"))


def _ranked(keys: DataFrame) -> DataFrame:
    """keys with `rank`, a number that grows with `key`; keys differ."""
    return C.cut(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("rank", F.monotonically_increasing_id()))


def sequence_ranks(rows: DataFrame, deepest: int) -> DataFrame:
    """conv_id, rank: the lexicographic order of conversations that all differ. rows: conv_id, depth, digest, with a depth 0 in each."""
    block = F.floor(F.col("at") / FAN).cast("long")
    rows, blocks = rows.select("conv_id", F.col("depth").alias("at"), F.col("digest").alias("item")), deepest + 1
    while True:
        keys = rows.groupBy("conv_id", block.alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("key"))  # FAN items at most
        blocks = -(-blocks // FAN)
        if blocks == 1:
            return _ranked(keys).select("conv_id", "rank")
        keys = C.cut(keys)
        names = _ranked(keys.groupBy("key").agg(F.count("*").alias("n")))
        rows = by_hot_key(keys, names, "key", "n", C.counted(keys)).select("conv_id", "at", F.col("rank").alias("item"))


def _ends(members: DataFrame) -> DataFrame:
    """rank, ends_sha256: the digest of the conversations of each sequence. members: rank, conv_id."""

    def run(batches):
        last, sha = None, None
        for batch in batches:
            out = []
            for rank, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rank != last:
                    if sha:
                        out.append((last, sha.hexdigest()))
                    last, sha = rank, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["rank", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["rank", "ends_sha256"])

    chunks = members.groupBy("rank", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return C.arrow(chunks.repartition("rank").sortWithinPartitions("rank", "chunk").select("rank", "ids"), run, "rank long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end of each node.

    turns: conv_id, depth (from 1), digest, words; convs: conv_id, each once, those without turns too.
    preorder counts nodes from 0, subtree_end is the place of the subtree's last node.
    """
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"))
    rows = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "digest", "words").unionByName(root)
    rows = running(rows.withColumns({f"g{k}": F.xxhash64(F.lit(k), "depth", "digest") for k in (1, 2)}), ["conv_id", "depth"], {"h1": "g1", "h2": "g2"}, "conv_id", xor=True)
    total, deepest = C.taken(rows.agg(F.count("*"), F.max("depth")))[0]
    here = ["depth", "h1", "h2"]

    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("h1", "h2"), "depth").alias("h")).select("conv_id", "depth", "h.h1", "h.h2")
    same = last.groupBy(*here).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    same = C.cut(same.withColumn("n", F.col("depth") + 1))
    rows = by_hot_key(rows, same.select("conv_id", "copies", "n"), "conv_id", "n", total).drop("n")
    ranks = sequence_ranks(rows, deepest or 0)
    same = C.cut(same.join(ranks, "conv_id"))
    rows = by_hot_key(rows, same.select("conv_id", "rank", "n"), "conv_id", "n", total)

    nodes = rows.groupBy(*here).agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("words").alias("words"), F.first(F.col("h1").bitwiseXOR(F.col("g1"))).alias("p1"), F.first(F.col("h2").bitwiseXOR(F.col("g2"))).alias("p2")
    )
    nodes = C.cut(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, here, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    one = F.lit(1).cast("long")
    nodes = nodes.withColumns({"node": one, "leaf": F.when(F.col("n_children") == 0, one).otherwise(0), "saves": (F.col("n_convs") - 1) * F.col("words"), "over": F.col("depth") - 1})
    nodes = running(nodes, ["lo", "depth"], {"c_node": "node", "c_leaf": "leaf", "c_saves": "saves"})
    count = C.counted(nodes)

    parents = nodes.where("n_children > 0").select(F.col("depth").alias("over"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    out = by_hot_key(nodes, parents, ["over", "p1", "p2"], "n", count, "left").drop("n")
    ends = nodes.groupBy(F.col("lo").alias("hi")).agg(*(F.max(c).alias(f"end_{c}") for c in ("c_node", "c_leaf", "c_saves"))).join(nodes.groupBy("hi").agg(F.count("*").alias("n")), "hi")
    out = by_hot_key(out, ends, "hi", "n", count).drop("n")

    members = by_hot_key(last, same.select(*here, "rank", F.col("copies").alias("n")), here, "n", total).select("rank", "conv_id")
    shas = same.select("rank", "depth").join(_ends(members), "rank").withColumnRenamed("rank", "lo")
    out = out.join(shas, ["lo", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end_c_leaf") - F.col("c_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end_c_saves") - F.col("c_saves") + F.col("saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), (F.col("c_node") - 1).alias("preorder"), (F.col("end_c_node") - 1).alias("subtree_end"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that were rebuilt with the beginnings of their family's first one."""
    turns = numbered(conversations)
    return trie(rebuilt(turns), turns.where("p = 1").select("conv_id"))
