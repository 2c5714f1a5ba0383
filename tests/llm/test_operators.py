import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import decontam, jaccard, line_rules, packing, secrets  # noqa: E402

from . import brute  # noqa: E402


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return brute.rows(spark, sf_dir)


@pytest.fixture(scope="module")
def docs(spark, data):
    return brute.frame(spark, data).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, count string, n_words int")


def test_secrets(docs, data, empty):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, text in data:
        base = brute.base_spans(text)
        s = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(s.split(",")) - {""} <= set(got[i].spans.split(","))
    assert secrets.scan(empty).count() == 0
    assert secrets.redact(docs).count() == len(data)


def test_guess_cost_is_the_least_over_all_segmentations():
    for s in ("password1", "qwerty2019", "aaaa1111", "Zx9!k", "abcabcabc", "2020-01-31x"):
        known = secrets.segments(s)

        def least(j):
            if not j:
                return 0.0
            return min([least(j - 1) + secrets._brute(s[j - 1]), *(least(i) + g + 0.3 for i, g, _ in known.get(j, ()))])

        assert secrets.guess_cost(s)[0] == pytest.approx(least(len(s)))
    assert secrets.guess_cost("password123")[0] < 4 < 10 < secrets.guess_cost("x9#Lq2!vR7kk")[0]
    assert secrets.find("my pwd: x9#Lq2!vR7kk")[0][:3] == (8, 3, 20)


def test_quality(docs, data, empty):
    got = {r.doc_id: r for r in line_rules.line_report(docs).collect()}
    for i, text in data:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), (i, text)
        assert not (r.base_failed and r.kept)
    assert line_rules.line_report(empty).count() == 0
    clean = line_rules.clean(docs)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.kept}


def test_line_rules():
    import pyarrow as pa

    prose = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(6))
    junk = {"navigation": "Home | News | Sport | About", "shouting": "BUY THIS THING NOW!", "boilerplate": "All Rights Reserved by us.", "repetition": "go go go go go.", "punctuation": "no stop here", "symbols": "a### b$$$ c%%%."}
    for line in junk.values():
        r = line_rules.judge(pa.array([prose + "\n" + line]), with_text=True)
        assert r["n_failed_lines"][0] == 1 and r["kept"][0] and r["clean_text"][0].as_py() == prose


def test_contamination(spark, docs, data, empty):
    items = [(r.item_id, r.text) for r in spark.createDataFrame([(1, brute.SHARED), (2, "One, two"), (10, "é"), (11, ""), (12, None), (13, brute.SHARED + " tail"), (14, "The SAME text said twice")], "item_id long, text string").collect()]
    some = [t for _, t in data if t and len(t) > 400][:5]
    items += [(20 + k, " ".join(t.split()[20:45])) for k, t in enumerate(some)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(data, items)
    for size in (32 << 20, 200):  # in one block and in several
        decontam_rows = decontam.hits(docs, bench, 10, size)
        assert decontam_rows.count() == len(data)
        got = {r.doc_id: len(r._hits) // 4 for r in decontam_rows.collect()}
        assert got == {i: w[1] for i, w in want.items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == want
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    after = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench.where("item_id in (1, 13)")).collect()}
    assert not any(t and brute.SHARED in t for t in after.values())


def test_packing(docs, data, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, by_seq = defaultdict(dict), defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r.doc_id][r.piece] = r
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in data:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k in range(len(got[i])):
            r = got[i][k]
            assert r.start == at and (r.length == 1024 or k == 0) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(x[1] for s in by_seq.values() for x in s)
    assert len(by_seq) <= max(1.05 * total / 1024, -(-total // 1024) + 2)
    assert packing.pack(empty).count() == 0


def test_plan_holds_every_length():
    rng = np.random.default_rng(3)
    for _ in range(5):
        hist = rng.integers(0, 9, 129)
        hist[0] = 0
        back = np.zeros_like(hist)
        for lengths, count in packing.plan(hist):
            assert sum(lengths) <= 128
            for n in lengths:
                back[n] += count
        assert (back == hist).all()


def test_jaccard(spark, docs, data, empty):
    long = [t for _, t in data if t and len(t) > 1500][:6]
    near = [(10_000 + 10 * k + j, " ".join(w if m != 30 + 25 * j else f"changed{j}" for m, w in enumerate(t.split()))) for k, t in enumerate(long) for j in range(4)]
    rows = data + near
    got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in jaccard.join(brute.frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.deduplicate(brute.frame(spark, rows))
    odd = brute.frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (None, None), (2, "a b c d e f")])
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in jaccard.join(odd).collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted((r.doc_id or 0) for r in jaccard.deduplicate(odd).collect()) == [0, 0, 0, 1]
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r[0] == i}


def test_jaccard_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(w if j % 50 != k % 50 or j > 150 else f"x{k}" for j, w in enumerate(words))) for k in range(60)]
    got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in jaccard.join(brute.frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows)


def test_pruning_rule_is_the_posterior():
    n, need = jaccard.least_matches()[0]
    grid = np.linspace(0, 1, 20001)
    for m, pruned in ((need - 1, True), (need, False)):
        p = grid**m * (1 - grid) ** (n - m)
        assert (p[grid >= 0.8].sum() / p.sum() < jaccard.TOLERANCE * 1.5) == pruned


def test_repeats(spark, docs, data, empty, monkeypatch):
    from gridlore.llm import exchange, repeats

    want = brute.repeats(data)
    for size in (exchange.CHUNK_BYTES, 40_000):
        monkeypatch.setattr(exchange.layout, "__defaults__", (size, size))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(docs).collect()}
        assert got == want
    spans = repeats.maximal(docs).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r["sum(length)"] for r in spans} == {i: w[1] for i, w in want.items() if w[1]}
    assert repeats.dedup(empty).count() == 0


def test_lm(spark, docs, data, empty, monkeypatch):
    import math
    from collections import Counter

    from gridlore.llm import exchange, lm

    toks = {i: [x.translate(brute.AZ) for x in brute.SPACED.findall(t or "")] + [None] for i, t in data}
    trains = {i: brute.crc_mod(i, 7) != 2 for i in toks}
    uni = Counter(x for i, w in toks.items() if trains[i] for x in w)
    bi = Counter(x for i, w in toks.items() if trains[i] for x in zip(["<s>", *w], w))
    n, v, starts = sum(uni.values()), len(uni), sum(trains.values())
    learned = []
    monkeypatch.setattr(lm, "learn", lambda cells, f=lm.learn: learned.append(f(cells)) or learned[-1])
    for size in (exchange.CHUNK_BYTES, 40_000):
        monkeypatch.setattr(exchange.layout, "__defaults__", (size, size))
        got = {r.doc_id: r for r in lm.score(docs).collect()}
        assert got.keys() == toks.keys()
        weights = learned[-1]
        assert np.allclose(weights.sum(1), 1) and weights[3:8, 0].mean() > 0.05
        for i, w in toks.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not trains[i], len(w), sum(uni[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
            own = 0.0
            for a, b in zip(["<s>", *w], w):
                c = starts if a == "<s>" else uni[a]
                x = weights[min(1 + int(math.log2(c)), lm.BUCKETS - 1) if c else 0]
                own += math.log10(x[0] * bi[a, b] / max(c, 1) + x[1] * uni[b] / n + x[2] / (v + 1))
            assert r.score == pytest.approx(own, rel=1e-9)
    better = sum(r.score > r.base_score for r in got.values() if r.held_out and r.n_tokens > 60)
    assert better > 0.8 * sum(r.held_out and r.n_tokens > 60 for r in got.values())
    assert lm.score(empty).count() == 0


def test_weights_are_those_of_plain_expectation_maximisation():
    from gridlore.llm import lm

    rng = np.random.default_rng(5)
    w, vw = rng.integers(0, 50, 4000), rng.integers(0, 4, 4000)
    vw = np.minimum(vw, w)
    code, big, one = lm.grid_cells(w, vw, 100, 100_000, 1e-3)
    cells = [(int(c), int((code == c).sum()), big[code == c].sum(), one[code == c].sum()) for c in np.unique(code)]
    got = lm.learn(cells)
    v = lm._contexts(w, 100)
    b, p = lm.bucket(v), np.stack([vw / np.maximum(v, 1) / 1e-3, w / 100_000 / 1e-3, np.ones(len(w))], 1)
    want = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1))
    want[0] = [0, 0.6, 0.4]
    for _ in range(200):
        g = p * want[b]
        g /= g.sum(1, keepdims=True)
        for k in np.unique(b):
            want[k] = np.maximum(g[b == k].mean(0), [0, 0, 1e-9])
            want[k] /= want[k].sum()
    assert np.abs(got - want)[np.unique(b)].max() < 0.02


def test_toxicity_gradients():
    from gridlore.llm import toxicity

    rng = np.random.default_rng(2)
    net = toxicity.Net(rng, np.arange(3, dtype=np.uint64))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, idx = rng.standard_normal((9, toxicity.WIDTH)), rng.integers(0, 9, (5, toxicity.WINDOW))
    length, y = np.array([48, 3, 0, 17, 1]), np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = net.forward(x, idx, length)
        return float((np.logaddexp(0, z) - y * z).mean())

    g, dx = net.gradients(x, idx, length, y, np.ones(5))
    for name, grad in [*g.items(), ("x", dx)]:
        value = x if name == "x" else net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old, eps = value[at], 1e-3
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(float(grad[at]), abs=3e-5), name


def test_toxicity_learns_and_scores_windows(spark, docs, data, empty):
    from gridlore.llm import toxicity

    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet") for b in ("em", "um", "or", "is", "at")]
    made = []
    for k in range(900):
        w = [words[j] for j in rng.integers(0, len(words), int(rng.integers(5, 260)))]
        if k % 4 == 0:
            w[int(rng.integers(0, len(w)))] = ("vilething", "nastyword")[k // 4 % 2]
        made.append((20_000 + k, " ".join(w), int(k % 4 == 0)))
    table = brute.frame(spark, [(i, t) for i, t, _ in made] + data)
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(20_000, 1), (None, 1), (20_001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table, labels).collect()}
    assert len(got) == len(made) + len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i], y) for i, _, y in made if brute.crc_mod(i, 5) == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.95
    assert toxicity.score(empty, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    n = np.array([0, 0, 47, 48, 49, 200])
    start, length, doc = toxicity.windows(np.cumsum(n))
    for d in range(1, 6):
        covered = {j for s, m in zip(start[doc == d - 1], length[doc == d - 1]) for j in range(s, s + m)}
        assert covered == set(range(np.cumsum(n)[d - 1], np.cumsum(n)[d]))


def test_licenses(spark, sf_dir, data, empty, tmp_path):
    import duckdb

    from gridlore.llm import licenses

    apache = "Copyright 2020 Someone. Licensed under the Apache License, Version 2.0 (the \"License\").\n"
    gpl = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the x), to deal. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS."
    cases = {
        "Some prose.\nLicensed under the Apache License, Version 2.0.": "Apache-2.0", "no end here***\n\nLicensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", gpl: "GPL-3.0-or-later", mit: "MIT",
        "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only,MIT", "All rights reserved.": "", "An unlicensed sentence about licences.": "", apache: "Apache-2.0",
    }
    table = brute.frame(spark, data + [(50_000 + k, t) for k, t in enumerate(cases)])
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert [got[50_000 + k].licenses for k in range(len(cases))] == list(cases.values())
    assert got[50_005].n_open == 1 and got[50_005].sentences == "reserved" and got[50_003].n_known == 3
    path = str(tmp_path / "d.parquet")
    table.toPandas().to_parquet(path)
    want = duckdb.sql(licenses.sql(f"'{path}'")).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.values())
    assert licenses.scan(empty).count() == 0
    import re

    for name, form in licenses.SENTENCES:  # the hints must not hide a sentence
        assert any(h in re.sub(r"[()|?]", " ", form) for h in licenses.HINTS), name
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_chat(spark, sf_dir, monkeypatch):
    from itertools import groupby

    from gridlore.llm import chat

    rng = np.random.default_rng(6)
    made = [(i, t, r, x) for i, t, r, x in ((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())]
    roles = ["user", "assistant", "system", "User ", None, "tool", ""]
    made += [(9000 + k, t, roles[int(rng.integers(0, 7))], None if t % 5 == 4 else f"text {k} {t} <|im_end|>") for k in range(60) for t in range(int(rng.integers(1, 9)))]
    made += [(9999, t, roles[int(rng.integers(0, 5))], f"long {t}") for t in range(700)] + [(None, 1, "user", "a"), (None, None, "user", "a"), (9100, 1, "user", "same"), (9100, 1, "user", "same")]
    frame = spark.createDataFrame([(*r, 1) for r in made], "conv_id long, turn long, role string, text string, part int")
    results = []
    for n in ("1", "3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((tuple(r) for r in chat.repair(frame).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2])))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
    assert chat.repair(frame.limit(0)).count() == 0
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    inputs = {c: sorted(g, key=key) for c, g in groupby(sorted(made, key=key), key=lambda r: r[0])}
    for conv, rows in groupby(results[0], key=lambda r: r[0]):
        rows = list(rows)
        turns = inputs[conv]
        assert [(r[1], r[3]) for r in rows] == [(t[1], t[2]) for t in turns] and [r[2] for r in rows] == list(range(len(rows)))
        # least cost by trying all states, turn by turn
        best = {0: 0}
        for t in turns:
            new = {}
            for s, c in best.items():
                for a, b, cost, _, _ in chat.choices(chat.role_number(t[2])):
                    if a == s:
                        new[b] = min(new.get(b, 1 << 30), c + cost)
            best = new
        assert sum(r[8] for r in rows) == min(c + chat.END[s][0] for s, c in best.items())
        whole = "".join(r[9] for r in rows)
        seen = [x.split("\n", 1)[0] for x in whole.split("<|im_start|>")[1:]]
        assert whole.count("<|im_end|>\n") == len(seen) and seen[-1] == "assistant" and seen[0] in ("system", "user")
        assert all((a, b) in {("system", "user"), ("user", "assistant"), ("assistant", "user")} for a, b in zip(seen, seen[1:]))
    clean = [r for r in results[0] if r[0] is not None and r[0] < 9000]
    assert np.mean([r[5] == "keep" for r in clean]) > 0.8


def test_packed_keys_and_counts_round_trip():
    from gridlore.llm import exchange as X

    rng = np.random.default_rng(9)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        assert (X.unpack_keys(X.pack_keys(keys), len(keys)) == keys).all()
        c = np.concatenate([rng.integers(0, 300, n), [0, 252, 253, 254, 255, 256, 65535, 65536, 1 << 31, 1 << 32, 1 << 40]])
        assert (X.unpack_counts(X.pack_counts(c), len(c)) == c).all()
