"""Secret scans: fixed patterns, and guess costs of the values that stand where credentials do.

Base spans are the patterns' (kinds assign, access, hex). The method adds spans of kind guess: values
in a credential context whose cheapest segmentation (dynamic programming over words, dates, repeats,
sequences, keyboard walks and brute-force spans) takes `least` decimal orders of guesses or more, if
no base span holds them. After `:` or `=` and in quotes the cost alone decides. Passed over is what
stands after ` is ` or ` was ` without quotes and has letters only or digits only: prose does. Null and empty
texts have no spans; repeated rows, and rows that repeat or lack a doc_id, are each reported; an empty table
gives none; other columns are not looked at; texts are read whole, and a value of any length takes time in
proportion to it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What stands before a value: a credential word, a separator, perhaps a quote.
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private)[_\-\x20]?key|login)[\"']?\x20*(?:[:=]|\x20is\x20|\x20was\x20)\x20*(?:[\"']([^\"'\n]{6,})[\"']|([^\s\"']{6,}))", re.I | re.A)
_HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "bearer", "key", "login")
_BASE_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Frequent words of passwords, most frequent first.
COMMON = (
    "password passwd secret admin root user login guest master letmein welcome monkey dragon shadow sunshine princess football baseball superman batman "
    "trustno hello freedom whatever michael jordan hunter ranger buster soccer hockey killer george charlie andrew summer winter spring autumn love "
    "test demo example sample changeme default please server system public private token access key my the this that your none null true false required"
).split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEAR = {c: {r[k + d] for d in (-1, 1) if 0 <= k + d < len(r)} | {o[j] for o in ROWS[max(0, i - 1) : i] + ROWS[i + 1 : i + 2] for j in (k - 1, k, k + 1) if 0 <= j < len(o)} for i, r in enumerate(ROWS) for k, c in enumerate(r)}
_LEET = str.maketrans("4@301!5$7", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")


@cache
def words() -> tuple[dict[str, int], int]:
    """Ranks of COMMON and then of the whole words (four letters or more) of the byte-level BPE vocabulary, which has frequent ones first; the longest one's length."""
    import public_tokenizers

    known = dict.fromkeys(COMMON)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
            if token[:1] == " " and token[1:].isalpha() and 4 <= len(token) - 1 <= 24:
                known[token[1:].lower()] = None
    return {w: k + 1 for k, w in enumerate(known)}, max(map(len, known))


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def segments(s: str) -> dict[int, list[tuple[int, float, str]]]:
    """By end: start, log10 guesses and kind of each span that is cheaper than brute force may be: words, dates, and of each longest repeat, sequence and walk what shares an end with it. Linear in len(s)."""
    low, n, out = s.lower(), len(s), {}
    if len(low) != n:
        low = s
    plain = low.translate(_LEET)
    rank, longest = words()
    add = lambda i, j, g, kind: out.setdefault(j, []).append((i, g, kind))
    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], math.log10(2))):
                if r := rank.get(form):
                    add(i, j, math.log10(r) + extra + (math.log10(2) if s[i:j] != low[i:j] else 0), "word")
                    break
        if s[i].isdigit() and (m := _DATE.match(s, i)):
            add(i, m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120), "date")
    for unit in range(1, 9):  # s[i] == s[i + unit] all along
        i = 0
        while i + unit < n:
            j = i
            while j + unit < n and s[j] == s[j + unit]:
                j += 1
            e = j + unit
            if j - i >= max(unit, 2) and not any(unit % u == 0 and s[i : e - u] == s[i + u : e] for u in range(1, unit)):
                for a, b in _ends(i, e, max(2 * unit, unit + 2)):
                    add(a, b, sum(map(_brute, s[a : a + unit])) + math.log10((b - a) / unit), "repeat")
            i = j + 1
    i = 0
    while i + 2 < n:
        j, d = i, ord(s[i + 1]) - ord(s[i])
        while abs(d) == 1 and j + 1 < n and ord(s[j + 1]) - ord(s[j]) == d:
            j += 1
        for a, b in _ends(i, j + 1, 3):
            add(a, b, math.log10(26 * (b - a)), "sequence")
        i = max(j, i + 1)
    i = 0
    while i + 2 < n:
        j, turns = i, [0]
        while j + 1 < n and low[j + 1] in _NEAR.get(low[j], ()):
            j += 1
            # a step that leaves the row, or jumps far, is a turn; the first step is none
            turns.append(turns[-1] + (j > i + 1 and ((low[j] in ROWS[0]) != (low[j - 1] in ROWS[0]) or abs(ord(low[j]) - ord(low[j - 1])) > 20)))
        for a, b in _ends(i, j + 1, 3):
            add(a, b, math.log10(26 * (b - a)) + math.log10(4) * (1 + turns[b - 1 - i] - turns[min(a + 1, b - 1) - i]), "walk")
        i = max(j, i + 1)
    return out


def _ends(i: int, j: int, least: int) -> Iterator[tuple[int, int]]:
    """The parts of a run from i to j that share an end with it and are `least` long."""
    for e in range(i + least, j + 1):
        yield i, e
    for a in range(i + 1, j - least + 1):
        yield a, j


def guess_cost(s: str) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation takes, and its spans."""
    if not s:
        return 0.0, []
    known, best, back = segments(s), [0.0] * (len(s) + 1), [(0, "brute")] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        best[j], back[j] = best[j - 1] + _brute(s[j - 1]), (j - 1, "brute")
        for i, g, kind in known.get(j, ()):
            if best[i] + g + 0.3 < best[j]:  # a span costs its choice too
                best[j], back[j] = best[i] + g + 0.3, (i, kind)
    parts, j = [], len(s)
    while j:
        i, kind = back[j]
        if parts and kind == "brute" == parts[-1][2]:
            parts[-1] = (i, parts[-1][1], kind)
        else:
            parts.append((i, j, kind))
        j = i
    return best[-1], parts[::-1]


def find(text: str | None, least: float = 10.0) -> list[tuple[int, int, int, float | None]]:
    """start, kind (its place in KINDS), end, and cost of each span, by start, then kind."""
    if not text:
        return []
    low = text.lower()
    base = []
    if any(h in low for h in _BASE_HINTS):
        base += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    more = []
    if any(h in low for h in _HINTS):
        held = sorted((s, e) for s, _, e, _ in base)
        k, far = 0, -1
        for m in CONTEXT.finditer(text):
            g = 1 if m[1] is not None else 2
            s, value = m.start(g), m[g].rstrip(".,;:!?)")
            e = s + len(value)
            while k < len(held) and held[k][0] <= s:
                far = max(far, held[k][1])
                k += 1
            prose = g == 2 and text[m.start() : s].rstrip(" ")[-1] not in ":=" and (value.isalpha() or value.isdigit())
            if far < e and len(value) >= 6 and not prose and (cost := guess_cost(value)[0]) >= least:
                more.append((s, 3, e, cost))
    return sorted(base + more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, least: float = 10.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (code points), n_guess, guess_log10 (the largest cost, else null)."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t, least) for t in block.column(1).to_pylist()]
        of = [[sum(x[1] == k for x in f) for f in found] for k in range(4)]
        base = [hashlib.sha256(_joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
        worst = [max((x[3] for x in f if x[1] == 3), default=None) for f in found]
        cols = [block.column(0), *(pa.array(c, pa.int64()) for c in of[:3]), pa.array(base), pa.array([_joined(f) for f in found]), pa.array(of[3], pa.int64()), pa.array(worst, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "guess_log10"])

    return C.map_blocks(C.documents(docs), fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, guess_log10 double")


def redacted(text: str | None, least: float = 10.0) -> str | None:
    """text with each stretch of spans replaced by the kind of its first."""
    parts, at, end = [], 0, 0
    for s, k, e, _ in find(text, least):
        if s >= end:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = end = max(e, end)
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, least: float = 10.0) -> DataFrame:
    """docs with their secrets replaced; n_chars, if there, follows."""
    schema = docs.schema

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: block.column(block.schema.get_field_index(n)) for n in schema.names}
        text = cols["text"]
        cols["text"] = pa.array([redacted(t, least) for t in text.to_pylist()], text.type)
        if "n_chars" in cols:
            cols["n_chars"] = pc.utf8_length(cols["text"]).cast(cols["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return C.map_blocks(docs, fn, schema)
