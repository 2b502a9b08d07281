"""Searches under a limit of time, and repeated ids."""

import time

import pytest

from quarrylight.operators import search, signals

CHUNK = "id string, path string, start_line int, content string"


def test_exploding_patterns_end(spark):
    """The chunk on which a pattern explodes is told in time; others are found as ever."""
    rows = [("a", "p", 1, "a" * 60 + "xb"), ("b", "p", 5, "aab\nxx\nab aab"), ("c", "p", 1, "none"), ("d", "p", 1, None)]
    df, began = spark.createDataFrame(rows, CHUNK), time.time()
    got = {r.id: r for r in search.search_bounded(df, "(a|a)*b", seconds=0.5).collect()}
    assert time.time() - began < 30 and set(got) == {"a", "b"}
    assert got["a"].state == "timed-out" and got["a"].match_count is None and got["a"].match_lines is None
    b = got["b"]
    assert (b.state, b.match_count, b.distinct_match_line_count, list(b.match_lines), b.match_lines_truncated) == ("found", 3, 2, [5, 7], False)
    few = search.search_bounded(df, "a", seconds=5.0, most_lines=1).where("id = 'b'").first()
    assert list(few.match_lines) == [5] and few.match_lines_truncated and few.match_count == 5
    assert not search.search_bounded(df.limit(0), "a").collect()
    for bad in ("a*", "(", "", "x" * 4097):
        with pytest.raises(ValueError):
            search.search_bounded(df, bad)


def test_first_places(spark):
    df = spark.createDataFrame([("i", "b", 1, "x"), ("i", "a", 2, "y"), ("i", "a", 2, "y"), ("j", "c", 1, None)], CHUNK)
    assert sorted(map(tuple, search.first_places(df).collect())) == [("i", "a", 2, "y"), ("j", "c", 1, None)]


def test_product_markers(spark):
    files = spark.createDataFrame([(f"f{i:03d}", "x\nuses DEXGUARD here\nStringFog, dexguard" if i % 2 else "none") for i in range(60)] + [("z", None)], "path string, content string")
    marks = signals.product_markers(files)
    assert sorted(map(tuple, marks.where("path = 'f001'").collect())) == [("DexGuard", "f001", 2), ("DexGuard", "f001", 3), ("StringFog", "f001", 3)]
    told = {r.product: (r.files, r.locators) for r in signals.marker_locators(marks).collect()}
    assert told == {p: (30, [f"f{i:03d}" for i in range(1, 40, 2)]) for p in ("DexGuard", "StringFog")}
    assert not signals.marker_locators(signals.product_markers(files.limit(0))).collect()
