"""Filter audit, BPE and prefix trie against plain versions, on tables and on rows made to be hard."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import bpe, interactions, prefix_trie, scans  # noqa: E402

from .test_handling import LONG, ROWS  # noqa: E402

LABELS = [(1, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (4, None, 1), (-9, 0, 1), (77, 1, 1)]


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    for part in {p or "" for _, _, p in docs}:
        fails = []
        for i, t, p in docs:
            t = t or ""
            if (p or "") == part:
                w = words(t)
                f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
                fails.append((i, {k for k, v in f.items() if v}))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for i, f in fails if x in f and not f & before]
                shapley[x] += len(removed)
                out[part, "".join(order), step] = [sum(not f & (before | {x}) for _, f in fails), len(removed), sum(x in f and bool(f & before) for _, f in fails), sum(f == {x} for _, f in fails), sum(i in good for i in removed), sum(i in toxic for i in removed)]
        for (p, o, step), row in out.items():
            if p == part:
                row.append(shapley[o[step - 1]])
    return out


def test_audit_equals_a_plain_one(spark):
    docs = [(i, t, ("en", None, "", "de")[k % 4]) for k, (i, t) in enumerate(ROWS)]
    docs += [(100 + k, ("same text of many " * 60, "Own words " + " ".join(f"w{j}" for j in range(120)), "A&B " * 30)[k % 3], "en" if k % 5 else "fr") for k in range(60)]
    table = spark.createDataFrame([(i, t, p, 1, "x", 2) for i, t, p in docs], "doc_id long, text string, lang string, mask int, part string, n int").repartition(5)
    known = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interactions.audit(table, known).collect()}
    assert got == plain_audit(docs, LABELS)
    assert interactions.audit(table.limit(0), known).count() == 0
    assert {tuple(r[4:9]) for r in interactions.audit(table, known.limit(0)).collect()} and all(r.good_lost == 0 for r in interactions.audit(table, known.limit(0)).collect())


def test_incidence_of_two_filters():
    orders, m = interactions.incidence(2)
    assert orders == ["AB", "BA"]
    # masks: none, A, B, both; columns: A first, then B; B first, then A
    assert m["kept"].tolist() == [[1, 1, 1, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert m["removed"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [1, 0, 1, 0]]
    assert m["redundant"].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 1]]
    assert m["unique"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 0, 0]]


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hard_texts():
    rng = np.random.default_rng(12)
    out = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 256)]
    out += [c * n for c in ("a", " ", "\n", ".", "0", "é", "字", "😀", "̀", "\x00", "'") for n in (1, 2, 3, 63, 64, 65, 3000)]
    out += ["", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "'<|endoftext|>s", "<|endoftext", "|>", "it's I'LL we'Ve 'S'd 'rex 'llama x'''s ' s ''re!'s", "'", "'r", "'v", "x'l", " \n \r\n\t x", "a b\u0085c"]
    out += ["".join(rng.choice(list(" \n\t'stredvlmaA1.!é"), 60)) for _ in range(800)] + ["".join(rng.choice(list("abcdehlorst"), 200)) for _ in range(40)]
    return out


def test_ids_are_those_of_tokenizers(spark, tok, monkeypatch):
    texts = hard_texts()
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(6)
    encoded = bpe.encode(rows)
    assert [r.ids for r in sorted(encoded.collect(), key=lambda r: r.doc_id)] == want
    assert [r.text for r in sorted(bpe.decode(encoded).collect(), key=lambda r: r.doc_id)] == texts
    # words with one fingerprint, and a memory that starts anew all the time
    from gridlore.llm import words as W

    flat = "".join(texts).encode()
    data, bounds = np.frombuffer(flat, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    plain = W.span_hash
    for limit, prints in ((50, plain), (1 << 18, lambda d, a, b: plain(d, a, b) % np.uint64(1000))):
        monkeypatch.setattr(bpe, "LIMIT", limit)
        monkeypatch.setattr(W, "span_hash", prints)
        table = bpe.Bpe(__import__("public_tokenizers").path("byte_bpe_50k.json"))
        ids, first = table.encode(data, bounds)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want


def test_long_words_merge_as_short_ones(tok):
    table = bpe.tables(None)
    for text in ("x" * 64, "ab" * 31, "thethethe" * 7, "é" * 32):
        raw = np.frombuffer(text.encode(), np.uint8)
        side, _ = table.merge(raw, np.array([0]), np.array([len(raw)]))
        assert table.merge_long(table.byte_id[raw].tolist()) == side.tolist() == tok.encode(text, add_special_tokens=False).ids
    long = "abc" * 40_000
    assert table.merge_long(table.byte_id[np.frombuffer(long.encode(), np.uint8)].tolist()) == tok.encode(long, add_special_tokens=False).ids


def test_decode_of_any_ids(spark, tok):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 50257, 40).tolist() for _ in range(200)] + [[], [50256], [200, 201], [99999, 5]]
    got = bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(999, None)], "doc_id long, ids array<int>"))
    want = {k: tok.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {999: ""}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_round_trip_rows(spark, tok):
    rows = [*ROWS, (5, "y" * 300_000)]
    got = bpe.round_trip(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3))
    want = []
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for q in nodes:
        if q:
            kids.setdefault(q[:-1], []).append(q)

    def below(q):
        stack, out = [q], []
        while stack:
            out.append(x := stack.pop())
            stack += kids.get(x, [])
        return out

    out = set()
    for q, members in nodes.items():
        sub = below(q)
        saved = sum((len(nodes[x]) - 1) * len(words(x[-1][1])) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(q))
        out.add((min(members), len(q), min(nodes[q[:-1]]) if q else None, len(members), len(kids.get(q, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = np.random.default_rng(13)
    rows = [(c, t, "user" if t % 2 else "assistant", ("hello", "hi there", "hi", "a b  c\td", "")[int(rng.integers(0, 5))]) for c in range(-30, 130) if c % 7 for t in range(int(rng.integers(1, 9)))]
    rows += [(200 + k, t, "user", f"common {t}") for k in range(50) for t in range(5)]  # one that many share
    rows += [(1000, t, "user", f"long {t}") for t in range(300)] + [(1019, t, "user", f"long {t}") for t in range(280)] + [(1013, t, "user", f"long {t % 2}") for t in range(290)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (300, None, None, None), (300, None, "user", None), (300, 1, "b", "x"), (300, 1, "a", "x"), (300, 1, "a", "x"), (301, 5, "user", LONG), (2**62, 1, "user", "far"), (-(2**63), 1, "user", "first of all"), (2**63 - 1, 1, "user", "last of all")]
    return rows


@pytest.mark.parametrize("fan", [3, 64])
def test_trie_equals_a_plain_one(spark, monkeypatch, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr("gridlore.llm.components.HUB", 20)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string, n int").repartition(7)
    out = prefix_trie.rebuilt_trie(table).collect()
    assert len(out) == len(want := plain_trie(rows)) and {tuple(r[:8]) for r in out} == want
    # preorder: each place once, a parent before its children, subtrees nested
    place = {r.preorder: r for r in out}
    assert sorted(place) == list(range(len(out))) and place[0].depth == 0 and place[0].subtree_end == len(out) - 1
    for r in out:
        inner = [place[k] for k in range(r.preorder + 1, r.subtree_end + 1)]
        assert all(x.depth > r.depth and x.subtree_end <= r.subtree_end for x in inner)
        assert sum(x.n_children == 0 for x in [r, *inner]) == r.n_leaves
    assert prefix_trie.rebuilt_trie(table.limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    none = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][0]
    out = prefix_trie.rebuilt_trie(spark.createDataFrame([(none, 1, "user", "gone"), (none, 2, "user", "gone too")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r[:8]) for r in out] == [(none, 0, None, 1, 0, 1, 0, hashlib.sha256(str(none).encode()).hexdigest())]


def test_running_sums_go_over_ranges(spark):
    rows = [(1, k, k % 5, k * 7919) for k in range(3000)] + [(2, 1, 4, 9)] + [(3, k, 2, k) for k in range(500)]
    table = spark.createDataFrame(rows, "key long, at long, x long, y long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.running(table, ["key", "at"], {"s": "x"}, "key").collect()
        mixed = scans.running(table, ["key", "at"], {"s": "y"}, "key", xor=True).collect()
        plain = scans.running(table, ["key", "at"], {"s": "x", "t": "y"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held, x, s, t = {}, {}, 0, 0
    want, want_x, want_all = {}, {}, {}
    for key, at, a, b in sorted(rows):
        held[key], x[key], s, t = held.get(key, 0) + a, x.get(key, 0) ^ b, s + a, t + b
        want[key, at], want_x[key, at], want_all[key, at] = held[key], x[key], (s, t)
    assert {(r.key, r["at"]): r.s for r in got} == want and {(r.key, r["at"]): r.s for r in mixed} == want_x and {(r.key, r["at"]): (r.s, r.t) for r in plain} == want_all
