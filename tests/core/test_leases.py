"""Leases of a stream against a plain version, over batches that cut them."""

import random
from datetime import datetime, timedelta, timezone

from gridlore.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, ttl):
    """What becomes of requests, and the leases that are left with their ends."""
    out, left = [], {}
    for at, who, key in sorted((at, who, key) for key, who, at in rows if who is not None):
        holder, end = left.get(key, (None, 0))
        if holder is not None and end <= at:
            out.append((key, holder, "expired", end))
            holder = None
        if holder not in (None, who):
            out.append((key, who, "refused", at))
            continue
        out.append((key, who, "claimed" if holder is None else "renewed", at))
        left[key] = (who, at + ttl)
    return out, left


def test_leases_expire_on_their_own(spark, tmp_path):
    r = random.Random(2)
    first = [(r.randrange(4), r.choice(["a", "b", None]), r.randrange(0, 40)) for _ in range(60)]
    second = [(r.randrange(4), r.choice(["a", "b"]), r.randrange(40, 90)) for _ in range(60)] + [(9, "c", 60), (8, "c", 89)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run(rows):
        table = spark.createDataFrame([(k, w, START + timedelta(minutes=at)) for k, w, at in rows], "key int, who string, ts timestamp")
        table.coalesce(1).write.mode("append").parquet(src)
        stream = live.leases(spark.readStream.schema(table.schema).parquet(src), "key", "who", "ts", 600, late="10 minutes")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()

    run(first)
    run(second)
    want, left = plain(first + second, 10)
    latest = max(at for _, _, at in second)
    want += [(k, who, "expired", end) for k, (who, end) in left.items() if end < latest - 10]
    base = int(START.timestamp() * 1e6)
    got = [(x.key, x.owner, x.what, (x.at - base) // 60_000_000) for x in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and (9, "c", "expired", 70) in got and (8, "c", "expired", 99) not in got
