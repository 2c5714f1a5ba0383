"""Chat formatting by minimum-cost role repair over a legal-turn automaton.

Legal conversations are an optional system turn, then user and assistant in turn, ending with the
assistant. Every input turn is emitted under a role (its own, or another: a relabel) as a new turn,
perhaps after an empty turn that is put in, or merged into the turn before it of that role; at the end
an empty assistant turn may be put in. Dynamic programming over the automaton's states takes the
cheapest choices. Equal costs are told apart by weights drawn from a checksum of the turn, the state
and the choice, so that the result doesn't depend on how rows are dealt out.

Turns are sorted by (conv_id, turn, role, text) and cut into partitions wherever they fall: of a
conversation that goes over several partitions each fragment becomes a min-plus matrix over the four
states, and the driver, with two fragments a partition at most, finds the states at the cuts. No
conversation needs to fit a task.

The result has a row for each input turn, with its piece of the rendered conversation: the pieces in
order of position are the whole. Null texts count as empty; roles other than system, user and
assistant, in any case (null too), are unknown and cheap to relabel; rows with a null conv_id are one
conversation, and null turns come first; repeated rows are turns of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
#: States: nothing yet, after a system, user, assistant turn. What may follow each.
LEGAL = ((1, 2), (2,), (3,), (2,))
_NEVER = (1 << 60, 0)


def choices(role: int) -> list[tuple[int, int, int, int, int]]:
    """(state, next state, cost, inserted role or 0, whether merged) for a turn of a role (1 to 3; 0: unknown)."""
    out = []
    for state in range(4):
        for x in (1, 2, 3):
            change = 0 if x == role else RELABEL if role else UNKNOWN
            if state == x:
                out.append((state, x, change + MERGE, 0, 1))
            if x in LEGAL[state]:
                out.append((state, x, change, 0, 0))
            out += [(state, x, change + INSERT, y, 0) for y in LEGAL[state] if x in LEGAL[y]]
    return out


CHOICES = [choices(r) for r in range(4)]
#: Cost to end in each state: as it is after the assistant, else with empty turns put in.
END = ((2 * INSERT, 0), (2 * INSERT, 0), (INSERT, 0), (0, 0))


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) + 1 if r in ROLES else 0


def _weight(turn: tuple, k: int) -> int:
    return zlib.crc32(f"{turn[0]}:{turn[1]}:{turn[2]}:{k}".encode())


def ahead(turns: list[tuple], best: list[tuple[int, int]]) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """From the cost to go after the last turn: for each turn the cost to go before it and the choice in each state."""
    out = []
    for turn in reversed(turns):
        now, pick = [_NEVER] * 4, [0] * 4
        for k, (s, t, c, _, _) in enumerate(CHOICES[role_number(turn[2])]):
            total = (best[t][0] + c, best[t][1] + _weight(turn, k))
            if total < now[s]:
                now[s], pick[s] = total, k
        best = now
        out.append((now, pick))
    return out[::-1]


def _matrix(turns: list[tuple]) -> list[list[tuple[int, int]]]:
    """Least cost from each state before to each state after the turns."""
    columns = []
    for end in range(4):
        columns.append(ahead(turns, [(0, 0) if s == end else _NEVER for s in range(4)])[0][0])
    return [[columns[e][s] for e in range(4)] for s in range(4)]


def _runs(batches):
    """Conversations of a partition sorted by them, as (conv, rows)."""
    conv, held, some = None, [], False
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if some and row[0] != conv:
                yield conv, held
                held = []
            conv, some = row[0], True
            held.append(row)
    if held:
        yield conv, held


def _piece(text: str | None, role: int, inserted: int, merged: int, first: bool, last: int | None) -> str:
    """last: the state at the end of the conversation, else None."""
    body = (text or "").replace("<|im_", "<| im_")
    if merged:
        out = "\n\n" + body
    else:
        out = "" if first else "<|im_end|>\n"
        if inserted:
            out += f"<|im_start|>{ROLES[inserted - 1]}\n<|im_end|>\n"
        out += f"<|im_start|>{ROLES[role - 1]}\n{body}"
    if last is not None:
        out += "<|im_end|>\n" + "".join(f"<|im_start|>{r}\n<|im_end|>\n" for r in {1: ("user", "assistant"), 2: ("assistant",), 3: ()}[last])
    return out


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, new_role, action (keep, merge, relabel, relabel_merge), inserted (role put in before, or empty), appended (roles put in at the end), cost, rendered."""
    spark = turns.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text"), F.monotonically_increasing_id().alias("_row"))
    order = ["conv_id", "turn", "role", "text", "_row"]  # so that equal turns can be cut too
    dealt = C.cut(t.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_row"))  # kept, as ranges are found by sampling
    parts = dealt.withColumn("part", F.spark_partition_id())

    def edges(batches):
        """Of a partition's first and last conversations: number of turns and matrix."""
        first = last = part = None

        def watched():
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column(b.schema.get_field_index("part"))[0].as_py()
                yield b

        for conv, rows in _runs(watched()):
            if first is None:
                first = (part, 0, conv, len(rows), _matrix(rows))
            last = (conv, rows)
        if last is not None:
            out = [first] + [(part, 1, last[0], len(last[1]), _matrix(last[1]))] * (last[0] != first[2])
            flat = [[x for row in o[4] for pair in row for x in pair] for o in out]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64()), (3, pa.int64()))] + [pa.array(flat, pa.list_(pa.int64()))], ["part", "side", "conv_id", "n", "matrix"])

    fragments = defaultdict(list)
    for r in sorted(C.arrow(parts, edges, "part int, side int, conv_id long, n long, matrix array<long>").collect(), key=lambda r: (r.part, r.side)):
        fragments[r.conv_id].append((r.part, r.n, [[(r.matrix[8 * s + 2 * e], r.matrix[8 * s + 2 * e + 1]) for e in range(4)] for s in range(4)]))
    known = {}
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    for conv, of in fragments.items():
        if len(of) < 2:
            continue
        best, go = list(END), []
        for _, _, m in reversed(of):
            go.append(best)
            best = [min(add(m[s][e], best[e]) for e in range(4)) for s in range(4)]
        state, at = 0, 0
        for k, ((part, count, m), best) in enumerate(zip(of, reversed(go))):
            known[part, conv] = (state, best, at, k == len(of) - 1)
            state = min(range(4), key=lambda e: add(m[state][e], best[e]))
            at += count
    shared = spark.sparkContext.broadcast(known)

    def apply(batches):
        part = None

        def watched():
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column(b.schema.get_field_index("part"))[0].as_py()
                yield b

        out: list[tuple] = []

        def batch():
            cols = list(zip(*out)) or [()] * 10
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "turn", "position", "role", "new_role", "action", "inserted", "appended", "cost", "rendered"])

        for conv, rows in _runs(watched()):
            state, best, at, ends = shared.value.get((part, conv), (0, list(END), 0, True))
            for k, (row, (_, pick)) in enumerate(zip(rows, ahead(rows, best))):
                r = role_number(row[2])
                _, to, cost, inserted, merged = CHOICES[r][pick[state]]
                last = to if ends and k == len(rows) - 1 else None
                action = ("" if to == r else "relabel") + ("_merge" if to != r and merged else "merge" if merged else "") or "keep"
                appended = {None: "", 1: "user,assistant", 2: "assistant", 3: ""}[last]
                out.append((row[0], row[1], at + k, row[2], ROLES[to - 1], action, ROLES[inserted - 1] if inserted else "", appended, cost + (END[last][0] if last else 0), _piece(row[3], to, inserted, merged, at + k == 0, last)))
                state = to
            if len(out) >= 2000:
                yield batch()
        yield batch()

    return C.arrow(parts, apply, "conv_id long, turn long, position long, role string, new_role string, action string, inserted string, appended string, cost long, rendered string")
