"""Streaming forms: running best, counters and gauges over results that arrive live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


#: Rows that a step on ordered rows takes further at a time.
CHUNK_ROWS = 50_000


def ordered(batches: Iterator[pd.DataFrame], seq: str, *names: str) -> tuple[np.ndarray, ...]:
    """The columns seq and names (as doubles) of a group's rows of a micro-batch, in the order of seq. Columns are all that is held: eight bytes a cell."""
    parts: list[list[np.ndarray]] = [[] for _ in (seq, *names)]
    for b in batches:
        for part, c in zip(parts, (seq, *names)):
            part.append(b[c].to_numpy() if c == seq else b[c].to_numpy(dtype=float, na_value=np.nan))
    out = []
    while parts:
        out.append(np.concatenate(parts.pop(0)))
    if (out[0][1:] < out[0][:-1]).any() or out[0].dtype.kind != "i":
        order = np.argsort(out[0], kind="stable")
        for k in range(len(out)):
            out[k] = out[k][order]
    return tuple(out)


def shares(seq: np.ndarray, busy: np.ndarray, total: np.ndarray, before: tuple[float, float]) -> Iterator[pd.DataFrame]:
    """seq and the share of what busy has grown by in what total has, before: the counters before the first row."""
    for k in range(0, len(seq), CHUNK_ROWS):
        to = k + CHUNK_ROWS
        db, dt = (np.diff(x[k:to], prepend=x[k - 1] if k else p) for x, p in zip((busy, total), before))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where((dt > 0) & ~np.isnan(db), np.maximum(db, 0) / dt, np.nan)
        yield pd.DataFrame({"seq": seq[k:to], "share": share})


def running_best(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Rows that exceed all earlier ones of their key; the state of a key is its best value and its number of rows."""
    ship(stream.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (float("-inf"), 0)
        at, values = ordered(batches, seq, value)
        before = pd.Series(values).cummax().shift().fillna(float("-inf")).clip(lower=best).to_numpy()
        new = (values > before).nonzero()[0]
        state.update((float(np.fmax(best, np.fmax.reduce(values))), int(n + len(values))))
        yield pd.DataFrame({"key": k[0], "seq": at[new], "value": values[new], "place": n + new})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, seq long, value double, place long", "best double, n long", "append", GroupStateTimeout.NoTimeout)


def gauges(stream: DataFrame, ts: str, by: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, sum and peak for each window and group; rows later than the watermark are an extension of ours to drop."""
    return event_time(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak")).select(F.col("window.start").alias("start"), by, "n", "total", "peak")


def counter_shares(stream: DataFrame, key: str, seq: str, busy: str, total: str) -> DataFrame:
    """Share of a counter in another since the sample before of the same key (falling counters count as 0); the state of a key is its last counters."""
    ship(stream.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, b, t = ordered(batches, seq, busy, total)
        before = state.get if state.exists else (float("nan"), float("nan"))
        state.update((float(b[-1]), float(t[-1])))
        for rows in shares(at, b, t, before):
            rows.insert(0, "key", k[0])
            yield rows  # a nan is a null to Spark

    kind = dict(stream.dtypes)[key]
    return stream.select(key, seq, busy, total).groupBy(key).applyInPandasWithState(step, f"key {kind}, seq long, share double", "busy double, total double", "append", GroupStateTimeout.NoTimeout)


def leases(stream: DataFrame, key: str, owner: str, ts: str, ttl_s: float, late: str = "1 day") -> DataFrame:
    """What becomes of each request for a key's lease: key, owner, what (claimed, renewed, refused, expired), at (microseconds).

    A request takes a lease that nobody has or that has run out, renews its owner's, and is refused while someone else's runs. A lease runs
    out ttl_s after it was taken or renewed last, and that is a row of its own: before the first request from then on, or, without one, by a
    timer once the watermark has passed it. Requests of one time are ordered by owner; null owners and times ask for nothing; what comes later than the watermark is dropped.
    The state of a key is the owner and the end of its lease, and goes with it. A key's requests of one micro-batch are held together: bound them by maxFilesPerTrigger.
    """
    ship(stream.sparkSession)
    ttl = int(ttl_s * 1_000_000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, end = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            out.append((holder, "expired", end))
            holder = None
        else:
            for who, at in pd.concat(list(batches)).sort_values(["_us", "owner"])[["owner", "_us"]].itertuples(index=False):
                if holder is not None and end <= at:
                    out.append((holder, "expired", end))
                    holder = None
                if holder is not None and holder != who:
                    out.append((who, "refused", at))
                    continue
                out.append((who, "claimed" if holder is None else "renewed", at))
                holder, end = who, int(at) + ttl
            if holder is not None and end // 1000 <= state.getCurrentWatermarkMs():
                out.append((holder, "expired", end))
                holder = None
        if holder is None:
            state.remove()
        else:
            state.update((holder, end))
            state.setTimeoutTimestamp(end // 1000)
        yield pd.DataFrame({"key": [k[0]] * len(out), "owner": [o[0] for o in out], "what": [o[1] for o in out], "at": [int(o[2]) for o in out]})

    rows = event_time(stream, ts).where(f"{owner} is not null and {ts} is not null").select(F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_us"))
    kind = dict(stream.dtypes)[key]
    return rows.withWatermark("_ts", late).groupBy("key").applyInPandasWithState(step, f"key {kind}, owner string, what string, at long", "holder string, ends long", "append", GroupStateTimeout.EventTimeTimeout)
