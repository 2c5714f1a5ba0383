import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import toxicity as T  # noqa: E402
from gridlore.llm import words as W  # noqa: E402

from . import brute  # noqa: E402

WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "con", "sec") for b in ("em", "um", "or", "is", "at", "er")]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_score(net, text):
    """A window, a direction and a token at a time, in doubles."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    tokens = brute.ALNUM.findall((text or "").translate(brute.AZ))
    inputs = []
    for t in tokens:
        one = W.split(pa.array([t]), W.ALNUM, lower=True)
        grams, _ = T.word_grams(one, np.array([0]))
        inputs.append(p["word"][net.number(W.word_hashes(one))[0]] + (p["gram"][grams].mean(0) if len(grams) else 0))
    best = -np.inf
    for start in range(0, max(1, len(tokens) - T.WINDOW + T.STRIDE), T.STRIDE):
        x = inputs[start : start + T.WINDOW]
        n, h = len(x), T.HIDDEN
        states = np.zeros((max(n, 1), 2 * h))
        for d, order, side in (("f", range(n), slice(0, h)), ("b", range(n - 1, -1, -1), slice(h, 2 * h))):
            s = np.zeros(h)
            for t in order:
                a, u = x[t] @ p[f"W{d}"] + p[f"b{d}"], s @ p[f"U{d}"]
                r, z = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                states[t, side] = s
        e = np.tanh(states @ p["A"] + p["c"]) @ p["v"]
        e = np.exp(e - e.max())
        best = max(best, (e / e.sum()) @ states @ p["u"] + p["o"][0])
    return sigmoid(best)


def test_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(1, 130)))) for _ in range(80)]
    labels = [int(k % 3 == 0) for k in range(80)]
    net = T.train([t + " vile" * y for t, y in zip(texts, labels)], labels)
    some = [None, "", "...", "one", texts[0], texts[1] + " vile vile", " ".join(WORDS * 5), "Unknown Wörter, ÄÖ 日本 x" * 9, texts[2]]
    got = T.scores(net, pa.array(some))
    assert np.allclose(got, [plain_score(net, t) for t in some], atol=2e-5)


def test_the_recurrent_part_learns_what_words_alone_cannot():
    """Both labels have the same words; only which of two words comes first tells them apart."""
    rng = np.random.default_rng(8)

    def make(n):
        out = []
        for k in range(n):
            w = rng.choice(WORDS, 12).tolist()
            at = int(rng.integers(0, 10))
            w[at : at + 2] = ["alpha", "omega"] if k % 2 else ["omega", "alpha"]
            out.append(" ".join(w))
        return out, [k % 2 for k in range(n)]

    net, (texts, labels) = T.train(*make(2000)), make(400)
    hit = np.mean((T.scores(net, pa.array(texts)) >= 0.5) == np.array(labels))
    assert hit > 0.9, hit


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_BYTES", 2000)
    docs = [(k, f"text {k} " + "x" * (1500 if k == 3 else 20)) for k in range(200)] + [(5, f"other {k}") for k in range(300)] + [(None, "no id"), (7, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(5, 0), (None, 1)], "doc_id long, toxic int")
    from gridlore.llm import common as C

    frame = C.documents(spark.createDataFrame(docs, "doc_id long, text string"))
    got = T.sample(frame, labels, per_class=20)
    assert 0 < len(got) <= 40 and sum(len(t.encode()) for t, _ in got) <= 2000 and {y for _, y in got} == {0, 1}
    assert got == T.sample(frame.repartition(7), labels, per_class=20)
    assert T.sample(frame, labels.limit(0)) == []
