"""Line-first cleaning: judge every line, remove the failures, reject texts that lose too much.

A line fails if it breaks one of these rules (lines without a word neither fail nor count):

- punctuation: it doesn't end, white space aside, in one of ``.!?;:"')`` or ``… ” » 。 ！ ？``, and
  it isn't prose cut short (20 words or more, one of which ends in ``.!?``);
- navigation: it has two ``|`` or more, one to five words or more;
- boilerplate: it equals an earlier line with a word, it has one of BOILERPLATE in it (ASCII case
  folded), or three symbols of ``#*$%&|<>`` or more, more than one to four words;
- shouting: of four words or more, with over six tenths of its ASCII letters in upper case;
- repetition: of four words or more, over half of them equal to the word before.

A text is rejected if fewer than half of its words stay, or if it fails the base rules (under 50
words, or over half of its words in three-word windows found twice or more in it). Null and empty
texts have no words and are rejected; repeated rows, and rows that repeat or lack a doc_id, are judged
each; an empty table gives none; columns of other names go through `clean` unseen; every text is read
whole. Equal lines and windows are told by 64-bit fingerprints within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C
from . import words as W

#: Phrases of page furniture.
BOILERPLATE = ("all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy", "sign up for", "subscribe to", "terms of use")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:\"')")] = True
#: … ” 。 ！ ？ (three bytes) and » (two bytes).
_ENDS3 = np.array([int.from_bytes(c.encode(), "big") for c in "…”。！？"])
_ENDS2 = int.from_bytes("»".encode(), "big")


def _count(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(flag)])
    return s[end] - s[start]


def _earlier_equal(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries equal one before them of the same text."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    same[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return same


def judge(col: pa.Array, with_text: bool = False) -> dict[str, np.ndarray | pa.Array]:
    b = W.split(col)
    data, n_docs = b.data, b.n_docs
    h = W.word_hashes(b)
    n_words = b.n_words
    cps = W.code_points(data)
    word_chars = W.per_doc(cps[b.end] - cps[b.start], b.first)
    sym = _SYMBOL[data]
    n_symbols = _count(sym, b.bounds[:-1], b.bounds[1:])

    gs = W.gram_starts(b, 3)
    g = W.gram_hashes(h, 3)[gs] if len(gs) else np.empty(0, np.uint64)
    order = np.lexsort((g, b.doc[gs]))
    gd, gg = b.doc[gs][order], g[order]
    eq = (gd[1:] == gd[:-1]) & (gg[1:] == gg[:-1])
    twice = np.zeros(len(g), bool)
    twice[order[1:]] |= eq
    twice[order[:-1]] |= eq
    n_repeat = W.per_doc(W.cover(gs[twice], 3, len(h)), b.first)

    brk = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([b.bounds[:-1], brk + 1]), kind="stable")
    ends = np.sort(np.concatenate([b.bounds[1:], brk]), kind="stable")
    line_doc = np.searchsorted(b.bounds[1:-1], brk, side="right") if n_docs else brk
    line_doc = np.sort(np.concatenate([np.arange(n_docs), line_doc]), kind="stable")
    w0, w1 = np.searchsorted(b.start, starts), np.searchsorted(b.start, ends)
    some = w1 > w0
    starts, ends, line_doc, w0, w1 = starts[some], ends[some], line_doc[some], w0[some], w1[some]
    n = w1 - w0
    dup = _earlier_equal(line_doc, W.span_hash(data, starts, ends))

    last = b.end[w1 - 1] if len(n) else np.empty(0, np.int64)
    tail = np.zeros(len(n), np.int64)
    for k in (3, 2, 1):
        tail = (tail << 8) | np.where(last - k >= 0, data[np.maximum(last - k, 0)].astype(np.int64), 0) if len(n) else tail
    ends_well = (_ENDS[tail & 0xFF] | np.isin(tail, _ENDS3) | ((tail & 0xFFFF) == _ENDS2)) if len(n) else np.empty(0, bool)
    bars, syms = _count(data == 0x7C, starts, ends), _count(sym, starts, ends)
    upper, lower = _count((data >= 0x41) & (data <= 0x5A), starts, ends), _count((data >= 0x61) & (data <= 0x7A), starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (b.doc[1:] == b.doc[:-1])
    if len(w0):
        again[w0] = False
    rep = _count(again, w0, w1)
    phrase = np.zeros(len(n), bool)
    low = W.LOWER[data].tobytes()
    for p in (p.encode() for p in BOILERPLATE):
        at = low.find(p)
        while at >= 0:
            k = np.searchsorted(starts, at, side="right") - 1
            if k >= 0 and at + len(p) <= ends[k]:
                phrase[k] = True
            at = low.find(p, at + 1)
    stops = np.isin(data[b.end - 1], list(b".!?")) if len(h) else np.zeros(0, bool)
    cut_short = (n >= 20) & (_count(stops, w0, w1) > 0)
    failed = ~(ends_well | cut_short) | ((bars >= 2) & (5 * bars >= n)) | dup | phrase | ((syms >= 3) & (4 * syms > n)) | ((n >= 4) & (10 * upper > 6 * (upper + lower))) | ((n >= 4) & (2 * rep > n))

    n_lines = np.bincount(line_doc, minlength=n_docs)
    n_dup = np.bincount(line_doc[dup], minlength=n_docs)
    kept_words = np.bincount(line_doc[~failed], weights=n[~failed], minlength=n_docs).astype(np.int64)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (2 * kept_words >= n_words), "n_lines": n_lines, "n_failed_lines": np.bincount(line_doc[failed], minlength=n_docs), "kept_words": kept_words,
    }
    if with_text:
        raw, lines = data.tobytes(), [[] for _ in range(n_docs)]
        for d, s, e in zip(line_doc[~failed].tolist(), starts[~failed].tolist(), ends[~failed].tolist()):
            lines[d].append(raw[s:e])
        out["clean_text"] = pa.array([b"\n".join(x) for x in lines], pa.binary()).cast(pa.string())
    return out


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row: doc_id, the base counts, base_failed, kept, and counts of lines and kept words."""

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        r = judge(block.column(1))
        more = ("n_lines", "n_failed_lines", "kept_words")
        cols = [block.column(0), *(pa.array(r[k], pa.int64()) for k in _LONGS), pa.array(r["base_failed"]), pa.array(r["kept"]), *(pa.array(r[k].astype(np.int64)) for k in more)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *_LONGS, "base_failed", "kept", *more])

    return C.map_blocks(C.documents(docs), fn, ", ".join(["doc_id long", *(f"{k} long" for k in _LONGS), "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, kept_words long"]))


def clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with their columns; failed lines are gone from text, and n_chars, if there, follows."""
    schema = docs.schema

    def fn(block: pa.RecordBatch) -> pa.RecordBatch:
        r = judge(block.column(block.schema.get_field_index("text")), with_text=True)
        cols = {f.name: block.column(k) for k, f in enumerate(block.schema)}
        cols["text"] = r["clean_text"].cast(block.schema.field("text").type)
        if "n_chars" in cols:
            cols["n_chars"] = pc.utf8_length(cols["text"]).cast(block.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(r["kept"]))

    return C.map_blocks(docs, fn, schema)
