"""The growing-lines source: ranges against plain splitting, and rows once over restarts in the middle of a file and of a line."""

import io
import json
import random

import pytest

from quarrylight.streaming import tail
from quarrylight.streaming.flows import FLOW


@pytest.mark.parametrize("seed", range(30))
def test_partitions_hold_each_line_once(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(tail, "PIECE", rng.choice([1, 3, 50]))
    data = b"".join(b"x" * rng.choice([0, 1, 7, 40]) + b"\n" for _ in range(rng.randrange(12)))
    partial = b"y" * rng.randrange(5)
    file, first = io.BytesIO(data + partial), rng.choice([0, data.find(b"\n") + 1])
    end = tail.last_line_feed(file, first, len(data + partial))
    assert end == max(first, len(data))
    part, got = rng.choice([1, 5, 1000]), []
    for a in range(first, end, part):
        got += tail.lines_of(file, tail.Lines("f", first, a, min(a + part, end), end))
    want, at = [], first
    for line in data[first:].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def flow(i):
    return "FLOW:" + json.dumps({"id": f"f{i}", "url": f"https://h/{i}", "method": "GET", "status": 200})


def test_rows_once_over_restarts(spark, tmp_path):
    """Each run goes on in the middle of a file; a line without its end waits; malformed lines are counted, not lost."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"

    def run():
        lines = tail.parsed(tail.tail(spark, str(folder), part_bytes=64), FLOW)
        q = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    a.write_text(f"{flow(1)}\nhello é\nFLOW:{{broken\n{flow(2)}\n{flow(3)[:20]}")
    assert sorted(r.record.id for r in run().where("state = 'flow'").collect()) == ["f1", "f2"]
    with a.open("a") as f:
        f.write(flow(3)[20:] + "\n\n")
    b.write_text(f"{flow(4)}\nFLOW:{{\"id\": \"x\"}}\n{flow(5)}")
    got = run()
    assert sorted(r.record.id for r in got.where("state = 'flow'").collect()) == ["f1", "f2", "f3", "f4"]
    with b.open("a") as f:
        f.write("\n" + "".join(flow(i) + "\n" for i in range(6, 40)))
    got = run()
    rows = got.collect()
    assert sorted(r.record.id for r in rows if r.state == "flow") == sorted(f"f{i}" for i in range(1, 40))
    assert len({(r.file, r.at) for r in rows}) == len(rows)
    counts = {(r.file.rsplit("/", 1)[1], r.state): r.lines for r in tail.line_states(got).collect()}
    assert counts == {("a.log", "flow"): 3, ("a.log", "malformed"): 1, ("a.log", "other"): 2, ("b.log", "flow"): 36, ("b.log", "malformed"): 1}
    assert run().count() == len(rows)
