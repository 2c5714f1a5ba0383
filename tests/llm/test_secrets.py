import math
import random

import pytest

pytest.importorskip("gridlore.llm")
from gridlore.llm import secrets  # noqa: E402

from . import brute  # noqa: E402

ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
AT = {c: (i, k) for i, r in enumerate(ROWS) for k, c in enumerate(r)}


def near(a, b):
    if a not in AT or b not in AT or a == b:
        return False
    (i, k), (j, m) = AT[a], AT[b]
    return (i == j and abs(k - m) == 1) or (abs(i - j) == 1 and abs(k - m) <= 1)


def letter(c):
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def runs(s, good, least):
    """Longest stretches in which each step is good, by trying all; a stretch starts where the one before ended."""
    out, i = [], 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and good(i, j):
            j += 1
        if j - i + 1 >= least:
            out.append((i, j + 1))
        i = max(j, i + 1)
    return out


def spans(s):
    """(start, end, cost) of every span of the model, each kind by its definition."""
    low, rank, out = s.lower(), secrets.words()[0], []
    leet = low.translate(str.maketrans("4@301!5$7", "aaeoiisst"))
    n = len(s)
    for i in range(n):
        for j in range(i + 2, n + 1):
            w = low[i:j]
            r, extra = (rank[w], 0) if w in rank else (rank[leet[i:j]], math.log10(2)) if leet[i:j] in rank else (0, 0)
            if r:
                out.append((i, j, math.log10(r) + extra + (math.log10(2) if s[i:j] != w else 0)))
    for i in range(n):
        if s[i].isdigit() and (m := secrets._DATE.match(s, i)):
            out.append((i, m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)))
    parts = lambda i, j, least: {(i, e) for e in range(i + least, j + 1)} | {(a, j) for a in range(i, j - least + 1)}
    for u in range(1, 9):
        for i in range(n):
            for j in range(i + max(2 * u, u + 2), n + 1):
                whole = all(s[k] == s[k + u] for k in range(i, j - u))
                longest = whole and (i == 0 or u > n - i or s[i - 1] != s[i - 1 + u]) and (j == n or s[j - u] != s[j])
                if longest and not any(u % v == 0 and all(s[k] == s[k + v] for k in range(i, j - v)) for v in range(1, u)):
                    out += [(a, b, sum(map(letter, s[a : a + u])) + math.log10((b - a) / u)) for a, b in parts(i, j, max(2 * u, u + 2))]
    step = lambda k: ord(s[k + 1]) - ord(s[k])
    for i, j in runs(s, lambda i, j: abs(step(i)) == 1 and step(j) == step(i), 3):
        out += [(a, b, math.log10(26 * (b - a))) for a, b in parts(i, j, 3)]
    for i, j in runs(low, lambda i, j: near(low[j], low[j + 1]), 3):
        for a, b in parts(i, j, 3):
            turns = sum((low[k] in ROWS[0]) != (low[k - 1] in ROWS[0]) or abs(ord(low[k]) - ord(low[k - 1])) > 20 for k in range(a + 2, b))
            out.append((a, b, math.log10(26 * (b - a)) + math.log10(4) * (1 + turns)))
    return out


def least(s):
    """The cheapest cover of s, by all covers, shortest first."""
    known, best = spans(s), [0.0]
    for j in range(1, len(s) + 1):
        best.append(min([best[j - 1] + letter(s[j - 1])] + [best[i] + g + 0.3 for i, e, g in known if e == j]))
    return best[-1]


def test_costs_are_those_of_a_plain_version():
    random.seed(5)
    pieces = ["password", "Passw0rd", "qwerty", "asdfghjkl", "abcabcabc", "aaaa", "1212", "20190131", "31/12/1999", "1987", "defgh", "98765", "zxcvfr4", "!Q", "x9#Lq2!", "dragon", "m0nkey", "tr33", "é字", "1qaz2wsx", "poiu", "--==", "letmein"]
    texts = ["".join(random.choices(pieces, k=random.randint(1, 4))) for _ in range(150)] + ["".join(random.choices("ab12!Qz", k=random.randint(1, 14))) for _ in range(150)]
    for s in texts + ["", "a", "aa", "abab", "aaaaaaaaab", "qwertyuiop[]", "2019-01-31x"]:
        cost, parts = secrets.guess_cost(s)
        assert cost == pytest.approx(least(s)), s
        assert "".join(s[a:b] for a, b, _ in parts) == s


def test_long_values_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        secrets.guess_cost("qwerty12aaaa" * n)
        return time.process_time() - began

    assert took(4000) < 8 * took(1000) + 0.5
    assert len(secrets.find("token: '" + "Ab1$" * 50_000 + "'")) == 1


def test_planted_guesses_are_found_and_prose_is_left(spark):
    random.seed(9)
    alphabet = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%&"
    planted = ["".join(random.choices(alphabet, k=14)) for _ in range(40)]
    forms = ["pwd: {}", "my login = '{}'", "the passphrase is \"{}\"", "credentials: {}", "Bearer: {} end", "pin={}"]
    rows = [(k, "Some prose before. " + forms[k % 6].format(p) + " and after.") for k, p in enumerate(planted)] + [(100, None), (101, ""), (None, "pwd: " + planted[0]), (7, "pwd: " + planted[1])]
    rows += [(200 + k, t) for k, t in enumerate(("The secret of the forest was discovered yesterday.", "login: administrator", "Token: understanding", "a pin is small", "authorization: required"))]
    got = secrets.scan(brute.frame(spark, rows)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id not in (7,)}
    for k, p in enumerate(planted):
        if k != 7:
            at = rows[k][1].index(p)
            assert any(x.startswith("guess:") and int(x.split(":")[1]) <= at and int(x.split(":")[2]) >= at + 12 for x in by[k].spans.split(",")), (rows[k], by[k])
    assert not any(by[k].n_guess for k in (100, 101, *range(200, 205))) and sum(r.n_guess for r in got if r.doc_id is None) == 1
    assert sum(r.doc_id == 7 for r in got) == 2
