"""Streams with state against the batch: after each micro-batch, over restarts, and by time."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quarrylight.operators import netflow
from quarrylight.streaming import captures

T0 = dt.datetime(2024, 1, 1)


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:04d}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def drain(query_of, checkpoint, mode):
    """Runs to the end of what there is; returns the rows of each micro-batch."""
    got = []
    q = query_of().writeStream.foreachBatch(lambda rows, n: got.append((n, [tuple(r) for r in rows.collect()]))).outputMode(mode).option(
        "checkpointLocation", str(checkpoint)
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return [rows for _, rows in sorted(got)]


def test_endpoints_equal_the_batch_after_each_micro_batch(spark, tmp_path):
    rng, schema, seen, latest = random.Random(3), "url string, method string", [], {}
    folder = tmp_path / "in"

    def stream():
        return captures.endpoint_updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), most_urls=3)

    for number in range(4):  # each a restart from the checkpoint
        for part in range(1 + number % 2):
            rows = [{"url": f"https://h{rng.randrange(2)}/a/{rng.randrange(9)}", "method": rng.choice(["GET", None])} for _ in range(rng.randrange(1, 12))]
            put(folder, 10 * number + part, rows)
            seen.append(rows)
        for rows in drain(stream, tmp_path / "cp", "update"):
            for r in rows:
                latest[r[:3]] = r[3:]
        every = spark.createDataFrame([(r["url"], r["method"]) for rows in seen for r in rows], schema)
        want = {(r.pattern, r.method, r.host): (r.flow_count, r.urls) for r in netflow.endpoints(every.na.fill("-"), 3).collect()}
        assert {(k[0], k[1] or "-", k[2]): (v[0], list(v[1])) for k, v in latest.items()} == want


def plain_sessions(flows, duration, silence):
    out = {}
    for key in {f[0] for f in flows}:
        now = None
        for _, at, sent, got in sorted(f for f in flows if f[0] == key):
            if now and at >= min(now[0] + duration, now[1] + silence):
                out.setdefault(key, []).append(now)
                now = None
            now = now or [at, at, 0, 0, 0]
            now[1:] = [at, now[2] + 1, now[3] + sent, now[4] + got]
        out.setdefault(key, []).append(now)
    return out


def test_sessions_end_by_duration_and_silence(spark, tmp_path):
    """However flows are dealt to micro-batches and restarts, and in whatever order within the delay: the sessions of the batch."""
    rng, schema = random.Random(5), "session_id string, ts timestamp, request_size long, response_size long"
    flows, at = [], {"a": 0, "b": 5, "c": 9}
    for _ in range(150):
        key = rng.choice("abc")
        at[key] += rng.choice([1, 5, 20, 59, 60, 61, 200])
        flows.append((key, at[key], rng.randrange(9), rng.randrange(9)))
    flows = sorted(flows, key=lambda f: f[1])
    want = plain_sessions(flows, 100, 60)
    folder, closed = tmp_path / "in", []

    def stream():
        return captures.sessions(
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(folder)), "100 seconds", "60 seconds", "30 seconds"
        )

    row = lambda f: {"session_id": f[0], "ts": (T0 + dt.timedelta(seconds=f[1])).isoformat(), "request_size": f[2], "response_size": f[3]}
    cut = [flows[i : i + 25] for i in range(0, len(flows), 25)]
    for number, some in enumerate(cut):
        put(folder, number, [row(f) for f in rng.sample(some, len(some))] + [{"session_id": None, "ts": None}])
        if number % 3 == 2:
            closed += [r for rows in drain(stream, tmp_path / "cp", "append") for r in rows]
    end = max(f[1] for f in flows) + 10_000
    put(folder, 900, [row(("z", end, 0, 0))])
    put(folder, 901, [row(("z", end + 1, 0, 0))])
    closed += [r for rows in drain(stream, tmp_path / "cp", "append") for r in rows]
    got = {}
    for key, started, ended, n, sent, back, reason in sorted(closed):
        a, b = (started - T0).total_seconds(), (ended - T0).total_seconds()
        got.setdefault(key, []).append((a, n, sent, back))
        assert b - a <= 100 and reason == ("duration" if b - a == 100 else "silence")
    assert got == {k: [(s[0], s[2], s[3], s[4]) for s in v] for k, v in want.items()}
    assert {r[6] for r in closed} == {"duration", "silence"}


def test_upserts_sweep_and_skip(spark, tmp_path):
    """A table of upserts keeps what its last two lists name; a batch number that is not there does no harm."""
    import os
    import shutil

    from quarrylight.streaming import flows

    folder, up, schema = tmp_path / "in", str(tmp_path / "up"), "id string, v long, ts timestamp"
    for n in range(5):
        put(folder, n, [{"id": f"k{i}", "v": n, "ts": (T0 + dt.timedelta(seconds=n)).isoformat()} for i in range(n, n + 3)])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        flows.upsert_latest(stream, up, str(tmp_path / "cp"), ["id"], "ts", buckets=4)
        if n == 2:  # as if the batch had never been
            shutil.rmtree(f"{up}/places/1")
    last = max(flows._numbers(spark, up))
    got = {r.id: r.v for r in flows.upserted(spark, up, last, spark.createDataFrame([], schema).schema).collect()}
    assert got == {"k0": 0, "k1": 1, "k2": 2, "k3": 3, "k4": 4, "k5": 4, "k6": 4} and flows._numbers(spark, up) == [last - 1, last]
    flows.upserted(spark, up, last - 1, spark.createDataFrame([], schema).schema).count()
    named = {f"{n}/_bucket={b}" for at in (last - 1, last) for b, n in flows._places(spark, up, at).items()}
    there = {f"{n}/{b}" for n in os.listdir(f"{up}/table") for b in os.listdir(f"{up}/table/{n}") if b.startswith("_bucket")}
    assert there == named
