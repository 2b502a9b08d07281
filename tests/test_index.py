"""Versions of an index: what readers see while it is rebuilt, conflicts, vacuum, and hybrid queries over odd tables."""

import threading

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import retrieval, snapshots

FILES = "path string, language string, content string"


def chunks(spark, *texts):
    rows = [(f"src/f{i}.java", "java", t) for i, t in enumerate(texts)]
    return retrieval.chunk_files(spark.createDataFrame(rows, FILES))


def state(spark, path, provider, version=None):
    c, v, s = retrieval.ready(spark, path, "i", provider, version)
    ids = {r.id for r in c.collect()}
    assert ids == {r.id for r in v.collect()} and {r.scope for r in s.where("level = 'file'").collect()} <= {r.path for r in c.collect()} | ids
    return sorted(r.content for r in c.collect())


def test_rebuild_is_seen_whole_or_not_at_all(spark, tmp_path):
    """A reader between the writes of a rebuild sees the version before; so does one that keeps its snapshot."""
    path, seen, turn = str(tmp_path), [], {}
    plain = retrieval.hashing(32)

    def watched(rows):
        # called after the new chunks are written, before vectors and summaries are
        seen.append(state(spark, path, plain))
        return plain.embed(rows)

    provider = retrieval.Provider(plain.name, 32, lambda rows: turn.get("f", plain.embed)(rows))
    assert retrieval.build(chunks(spark, "one", "two"), path, "i", provider)["version"] == 0
    held = retrieval.ready(spark, path, "i", provider)
    turn["f"] = watched
    assert retrieval.build(chunks(spark, "three", "four"), path, "i", provider)["version"] == 1
    assert seen == [["one", "two"]] and state(spark, path, provider) == ["four", "three"]
    assert sorted(r.content for r in held[0].collect()) == ["one", "two"] and held[1].count() == 2
    assert state(spark, path, provider, version=0) == ["one", "two"]


def test_failed_rebuild_leaves_the_index(spark, tmp_path):
    path, plain = str(tmp_path), retrieval.hashing(32)
    retrieval.build(chunks(spark, "one"), path, "i", plain)
    bad = retrieval.Provider(plain.name, 32, lambda rows: plain.embed(rows).where(F.lit(False)))
    with pytest.raises(ValueError):
        retrieval.build(chunks(spark, "two", "three"), path, "i", bad)
    assert state(spark, path, plain) == ["one"]
    root = retrieval.place(path, "i")
    assert not snapshots.vacuum(spark, root) and len(snapshots.vacuum(spark, root, staged_for=0.0)) == 2
    assert state(spark, path, plain) == ["one"]


def test_conflict_and_vacuum(spark, tmp_path):
    """Of two writers on one version one wins; old versions go with the folders that only they name."""
    path, made = str(tmp_path), []
    df = spark.range(3)
    base = snapshots.snapshot(spark, path)
    assert base.version == -1

    def writer(n):
        place = snapshots.stage(df.limit(n), path, "t")
        try:
            made.append(snapshots.publish(spark, base, {"t": place}, {"n": n}).version)
        except snapshots.Conflict:
            made.append("conflict")

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert made.count(0) == 1 and made.count("conflict") == 2
    now = snapshots.snapshot(spark, path)
    assert now.read(spark, "t").count() == now.properties["n"]
    for _ in range(3):
        now = snapshots.publish(spark, now, {"u": snapshots.stage(df, path, "u")}, {})
    assert snapshots.versions(spark, path) == [0, 1, 2, 3]
    gone = snapshots.vacuum(spark, path, keep=2)
    assert len(gone) == 1 and snapshots.versions(spark, path) == [2, 3]
    assert now.read(spark, "t").count() and now.read(spark, "u").count() == 3
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, path, 0)


def test_vectors_are_reused_by_name_only(spark, tmp_path):
    path, p = str(tmp_path), retrieval.hashing(32)
    first = retrieval.build(chunks(spark, "one", "two"), path, "a/b", p)
    again = retrieval.build(chunks(spark, "one", "two"), path, "a/b", p)
    assert not first["reused"] and again["reused"] and again["version"] == 1
    # as many chunks, but others
    assert not retrieval.build(chunks(spark, "one", "six"), path, "a/b", p)["reused"]


def test_hybrid_without_vectors(spark):
    """No vector: known paths and words still rank; no chunk: no row."""
    c = chunks(spark, "find the key here", "nothing")
    none = spark.createDataFrame([], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, "the key", ["key"], [1.0, 0.0])], "query_id long, phrase string, words array<string>, vector array<double>")
    got = retrieval.hybrid(c, none, asked, 5, known=["src/"]).orderBy("rank").collect()
    assert [r.content for r in got] == ["find the key here", "nothing"] and got[0].semantic_score == 0.0 and got[0].location_boost == 1.0
    assert not retrieval.hybrid(c, none, asked, 5).collect()
    assert not retrieval.hybrid(c.limit(0), none, asked, 5, known=["src/"]).collect()
    assert not retrieval.hybrid(c, none, asked.limit(0), 5, known=["src/"]).collect()
