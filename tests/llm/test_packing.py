import numpy as np
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import packing  # noqa: E402

from . import brute  # noqa: E402


def test_ids_are_those_of_tokenizers():
    """The faster reader of the vocabulary against the named one, on texts made to tell them apart."""
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(11)
    texts = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 256)]
    texts += [c * n for c in ("a", " ", "\n", "\t", ".", "0", "é", "字", "😀", "̀", "​", "\x00", "'") for n in (1, 2, 3, 7, 64, 65, 1000, 20_000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "|>", "it's I'LL we'Ve 'S'd", " \n \r\n\t x", "é " + unicodedata.normalize("NFC", "é"), "﻿x", "a b\u0085c"]
    texts += ["".join(chr(int(c)) for c in rng.choice([*range(1, 0x250), *range(0x4E00, 0x4E40), 0x1F600, 0x200D, 0xFE0F], 400)) for _ in range(60)]
    for t, got in zip(texts, fast(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("name", ["long", "short", "repeated"])
def test_most_sequences_come_from_patterns(name, monkeypatch):
    rng = np.random.default_rng(1)
    hist = np.zeros(1025, np.int64)
    if name == "repeated":
        for n, c in ((700, 9000), (600, 8000), (350, 9000), (333, 7000), (90, 20000)):
            hist[n] = c
    else:
        lengths = np.exp(rng.normal(6.5, 1, 50_000) if name == "long" else rng.normal(3.5, 0.6, 200_000)).astype(int) + 1
        np.add.at(hist, lengths[lengths % 1024 > 0] % 1024, 1)
    plain, tails = packing.best_fit, []
    monkeypatch.setattr(packing, "best_fit", lambda h: tails.append(plain(h)) or tails[-1])
    groups, back = packing.plan(hist), np.zeros_like(hist)
    for g, c in groups:
        assert sum(g) <= 1024
        for n in g:
            back[n] += c
    assert (back == hist).all()
    total, tail = sum(c for _, c in groups), min(sum(c for _, c in t) for t in tails)
    assert total <= sum(c for _, c in plain(hist)) and total - tail > 0.5 * total


def test_fit_is_a_least_squares_one():
    """Against all patterns at once, by Lawson and Hanson's conditions: gradients are zero where a count is positive, not negative where it is zero."""
    hist = np.zeros(65, np.int64)
    hist[[10, 12, 20, 22, 24, 30, 32, 34, 40, 42, 44, 52, 54]] = [90, 30, 50, 45, 80, 25, 70, 40, 60, 90, 35, 65, 20]
    pats = [p for p in packing.patterns(hist) if sum(p) == 64]
    x = packing.fit_counts(pats, hist, rounds=20_000)
    a = np.zeros((65, len(pats)))
    for k, p in enumerate(pats):
        for n in p:
            a[n, k] += 1
    g = a.T @ (a @ x - hist)
    assert (x >= 0).all() and (g > -1e-3).all() and abs(g[x > 1e-3]).max() < 1e-3


def test_rows_of_one_id_each_get_a_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    rows = [(1, "same text")] * 40 + [(None, "same text")] * 30 + [(1, "w " * 3000), (1, "w " * 3000), (None, None), (2, "")]
    got = packing.pack(brute.frame(spark, rows)).collect()
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places) == 74 + 2 * (got and max(r.piece for r in got))
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
