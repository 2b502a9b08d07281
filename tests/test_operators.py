"""Operators on small cases worked out by hand."""

import hashlib
import io
import json
import math
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import chunking, evaluate, inventory, lineage, manifest, ranking, report, retrieval, search, store, vectors
from quarrylight.sources import corpus, packages
from quarrylight.streaming import flows


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("😀", 1), ("😀😀", 2)])
def test_token_estimate(spark, text, n):
    assert one(spark, X.token_estimate(F.col("t")), t=text) == n


def test_tokens(spark):
    assert one(
        spark, X.tokens(F.col("t")), t="getHTTPUrl x2"
    ) == ["gethttpurl", "get", "url", "x2", "x", "2"] or one(spark, X.tokens(F.col("t")), t="fooBar 12") == ["foobar", "foo", "bar", "12"]
    assert one(spark, X.bigrams(X.query_tokens(F.col("t"))), t="a b a c") == ["a::b", "b::c"]


def test_windows_overlap(spark):
    f = spark.createDataFrame(
        [("p", "text", "1\n2\n3\n4\n5\n6\n7\n"), ("q", "text", ""), ("r", "text", None)],
        "path string, language string, content string",
    )
    rows = chunking.line_windows(f, size=3, overlap=1).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.content) for r in rows] == [
        (1, 3, "1\n2\n3"), (3, 5, "3\n4\n5"), (5, 7, "5\n6\n7")
    ]


def test_chunk_id(spark):
    row = ("p.txt", "text", "file", "<file>", 1, 2, "a\nb")
    c = spark.createDataFrame(
        [row], "path string, language string, kind string, symbol string, start_line int, end_line int, content string"
    )
    whole = {
        "schema_version": "1.0",
        "language": "text",
        "kind": "file",
        "path": "p.txt",
        "symbol": "<file>",
        "start_line": 1,
        "end_line": 2,
        "start_instruction": None,
        "end_instruction": None,
        "content_sha256": hashlib.sha256(b"a\nb").hexdigest(),
    }
    assert c.select(chunking.chunk_id().alias("x")).first().x == "chk_" + hashlib.sha256(
        json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()
    ).hexdigest()


def test_gaps_cover_the_rest(spark):
    i = spark.createDataFrame([("a", 2, 3), ("a", 4, 5), ("a", 9, 20)], "k string, start_line long, end_line long")
    t = spark.createDataFrame([("a", 10), ("b", 5)], "k string, n long")
    assert sorted(
        map(tuple, chunking.gaps(i, t, "k", "n", piece=3).collect())
    ) == [("a", 1, 1), ("a", 6, 8), ("b", 1, 3), ("b", 4, 5)]


def test_enclosing(spark):
    p = spark.createDataFrame([("f", 5), ("f", 50)], "path string, offset long")
    s = spark.createDataFrame([("f", 0, 20, "A"), ("f", 3, 9, "B")], "path string, open long, close long, name string")
    assert {r.offset: r.nesting for r in chunking.enclosing(p, s).collect()} == {5: "A.B", 50: ""}


def test_search_lines_are_capped(spark):
    c = spark.createDataFrame(
        [("i", "p", 20, "\n".join(["cipher x"] * 50))], "id string, path string, start_line int, content string"
    )
    r = search.search(c, "CIPHER", most_lines=5).first()
    assert (
        r.match_count, r.distinct_match_line_count, list(r.match_lines), r.match_lines_truncated
    ) == (50, 50, [20, 21, 22, 23, 24], True)
    with pytest.raises(ValueError):
        search.search(c, "a*", regex=True)


def test_pack_skips_and_falls_back(spark):
    r = spark.createDataFrame(
        [("q", 1, "a", 40, None), ("q", 2, "b", 400, 8), ("q", 3, "c", 400, None), ("q", 4, "d", 4, None)],
        "query_id string, rank int, id string, source_bytes long, summary_bytes long",
    )
    got = [(x.id, x.representation, x.estimated_tokens) for x in ranking.pack_budget(r, 20).orderBy("rank").collect()]
    assert got == [("a", "source", 10), ("b", "summary", 3), ("d", "source", 1)]
    assert ranking.pack_budget(r, 0).count() == 0


def test_metrics(spark):
    r = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 2, "x"), (2, 3, "b")], "case_id int, rank int, id string"
    )
    d = evaluate.dedupe_ranks(r, 10)
    m = evaluate.metrics(evaluate.first_relevant(d, r, F.col("id") == "b"), [1, 3]).first()
    assert (m.cases, m.hit_at_1, m.hit_at_3, m.mrr) == (2, 0, 2, 0.5)
    with pytest.raises(ValueError):
        evaluate.metrics(d, [1, 1])


def test_hash_embedding(spark):
    c = spark.createDataFrame([("a", ""), ("b", "cipher secret"), ("c", None)], "path string, content string")
    v = {r.path: r.vector for r in vectors.hash_embedding(c, 32).collect()}
    assert not any(v["a"]) and not any(v["c"]) and abs(sum(x * x for x in v["b"]) - 1) < 1e-9


def plain_embedding(text, d):
    """The same by a plain loop."""
    words = []
    for t in re.findall(r"[A-Za-z_$][A-Za-z0-9_$.-]*|[0-9]+", text or ""):
        words.append(t.lower())
        words += [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+", t) if p.lower() != t.lower()]
    v = [0.0] * d
    for f in [*words, *(f"{a}::{b}" for a, b in zip(words, words[1:]))]:
        h = hashlib.blake2b(f.encode(), digest_size=16).digest()
        v[int.from_bytes(h[:8], "big") % d] += 1 if h[8] & 1 else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_hash_embedding_by_a_plain_loop(spark):
    d = spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet"
    ).select("doc_id", F.col("text").alias("content")).limit(60)
    more = spark.createDataFrame(
        [(-1, "getHTTPUrl x2 getHTTPUrl"), (-2, None), (-3, "one"), (-4, "é ü 12")], "doc_id long, content string"
    )
    for r in vectors.hash_embedding(d.union(more), 384).collect():
        assert max(abs(a - b) for a, b in zip(r.vector, plain_embedding(r.content, 384))) < 1e-9


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[5] = v[9] = v[7]
    v[11] = 0
    d = spark.createDataFrame(
        [(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>"
    ).repartition(5)
    q = d.where("id % 20 = 0 or id = 7").select(d.id.alias("query_id"), d.vector.alias("query"))
    unit = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    for block in (3, 1000):
        got = {}
        for r in vectors.nearest(d, q, 6, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i, ids in got.items():
            assert ids == sorted(range(200), key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:6]
        assert len(got) == q.count()


def source(i):
    return f"class C{i} {{\n  void m{i}() {{\n    Cipher.run({i});\n  }}\n}}\n"


def test_index_is_built_reused_and_checked(spark, tmp_path):
    files = spark.createDataFrame(
        [(f"a/f{i}.java", "java", source(i)) for i in range(5)], "path string, language string, content string"
    )
    c = retrieval.chunk_files(files)
    p, path = retrieval.hashing(32), str(tmp_path)
    first = retrieval.build(c, path, "i1", p)
    assert first["chunks"] == 5 and not first["reused"] and retrieval.build(c, path, "i1", p)["reused"]
    assert not retrieval.build(c.where("path <> 'a/f0.java'"), path, "i2", p)["reused"]
    chunks, v, summaries = retrieval.ready(spark, path, "i1", p)
    assert chunks.count() == v.count() == 5 and {
        r.level for r in summaries.collect()
    } == {"class", "package", "project"}
    for wrong in (retrieval.hashing(64), retrieval.Provider("other", 32, p.embed)):
        with pytest.raises(ValueError, match="another provider"):
            retrieval.ready(spark, path, "i1", wrong)
    with pytest.raises(ValueError, match="not published"):
        retrieval.ready(spark, path, "none", p)
    bad = retrieval.Provider("bad", 16, p.embed)
    with pytest.raises(Exception, match="another length"):
        retrieval.build(c, path, "i3", bad)
    q = spark.createDataFrame(
        [("q", "Cipher.run(3)", ["cipher", "m3"])], "query_id string, phrase string, words array<string>"
    )
    asked = p.embed(q.withColumn("content", F.col("phrase")))
    best = retrieval.hybrid(chunks, v, asked, 3, known=["a/f4"])
    assert best.where("rank = 1").first().path == "a/f3.java" and best.count() == 3
    packed = retrieval.pack(best, 60).orderBy("rank").collect()
    assert packed[0].representation == "source" and packed[0].text.startswith("[source id=") and any(
        r.representation == "omitted" for r in packed
    )


def test_metadata_roles_and_bases(spark):
    docs = {
        "a": {"files": [{"file": "x/base.apk", "Split-Id": "master"}, {"apk": "c.apk", "id": "config.en"}, {"deep": [{"path": "d.apk", "isBase": True}]}]},
        "b": {"baseFile": "q.apk", "n": 1},
        "c": [1, 2],
    }
    d = spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in docs.items()] + [("e", "{broken")], "bundle string, json string"
    )
    got = {(r.bundle, r.reference, r.is_base, r.split_id) for r in inventory.metadata_roles(d).collect()}
    assert got == {
        ("a", "x/base.apk", True, None),
        ("a", "c.apk", False, "config.en"),
        ("a", "d.apk", True, None),
        ("b", "q.apk", True, None),
    }
    p = spark.createDataFrame(
        [
            ("a", "base.apk", True),
            ("a", "Base.apk", True),
            ("b", "mybase.apk", True),
            ("b", "x.apk", False),
            ("c", "x.apk", False),
            ("d", "x.apk", True),
            ("d", "y.apk", True)
        ],
        "bundle string, name string, has_dex boolean",
    )
    assert {r.bundle: (r.base, r.problem) for r in inventory.base_packages(p).collect()} == {
        "a": (None, "several-by-name"), "b": ("mybase.apk", None), "c": ("x.apk", None), "d": (None, "no-base")
    }


def test_tree_hash_by_hand(spark):
    rows = [("b/é", b"xy"), ("a", b"")]
    d = spark.createDataFrame(
        [("t", n, len(x), hashlib.sha256(x).hexdigest()) for n, x in rows],
        "k string, name string, size long, sha256 string",
    )
    h = hashlib.sha256()
    for n, x in sorted(rows):
        h.update(
            len(n.encode()).to_bytes(8, "big") + n.encode() + len(x).to_bytes(8, "big") + hashlib.sha256(x).digest()
        )
    assert inventory.tree_hash(d, "k").first().sha256 == h.hexdigest()


def test_har_headers_that_repeat(spark, tmp_path):
    heads = [{"name": "Set-Cookie", "value": "a"}, {"name": "set-cookie", "value": "b"}, {"name": "X", "value": "1"}]
    entry = {
        "startedDateTime": "2024-01-01T00:00:00Z",
        "time": 1.0,
        "request": {"method": "GET", "url": "https://h/1", "headers": []},
        "response": {"status": 200, "headers": heads, "content": {}},
    }
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [entry]}}))
    assert corpus.har(spark, str(tmp_path / "a.har")).first().response_headers == {"set-cookie": "b", "x": "1"}


def test_oversize_files_are_read_by_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    lines = [f"line {i}" for i in range(1, 24)]
    (tmp_path / "src" / "big.txt").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "src" / "small.txt").write_text("x\n")
    w = corpus.oversize_windows(
        spark, str(tmp_path / "src"), parse_limit=50, size=5, overlap=1
    ).orderBy("start_line").collect()
    assert [(r.path, r.start_line, r.end_line) for r in w] == [
        ("big.txt", a, min(a + 4, 23)) for a in (1, 5, 9, 13, 17, 21)
    ][: len(w)] and w[-1].end_line == 23
    assert all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in w)


def test_containing(spark):
    d = spark.createDataFrame(
        [(1, "so a b c d e f g h end"), (2, "xxa b c d e f g hyy"), (3, "a b c d e f g"), (4, None)],
        "doc_id long, text string",
    )
    p = spark.createDataFrame(
        [("i", "a b c d e f g h"), ("j", "b c"), ("k", "e f g"), ("l", ""), ("m", None)],
        "item_id string, phrase string",
    )
    assert {
        (r.item_id, r.doc_id) for r in search.containing(d, p, "text", "phrase").collect()
    } == {("i", 1), ("i", 2), ("j", 1), ("j", 2), ("j", 3), ("k", 1), ("k", 2), ("k", 3)}


def test_regular_expressions_that_repeat_repeats(spark):
    c = spark.createDataFrame([("i", "p", 1, "aaa")], "id string, path string, start_line int, content string")
    for bad in ("(a+)+b", "(?:x*){2,}", "a*"):
        with pytest.raises(ValueError):
            search.search(c, bad, regex=True)
    assert search.search(c, r"\(a\+\)|a{3}", regex=True).first().match_count == 1


def test_report_document(spark):
    t = spark.createDataFrame([(i, f"n|{i}") for i in range(3)], "k int, name string")
    table = report.markdown_table(t, ["k", "name"], ["k"], most=2)
    text, sha, have, lack = report.static_report(
        "Report", "Only what is allowed.", [("Package", table), ("Manifest", None)], ["run_1"], ["Static only."]
    )
    assert have == ["Package"] and lack == ["Manifest"] and "1 more rows are not shown." in text and "- `run_1`" in text and hashlib.sha256(text.encode()).hexdigest() == sha


def test_loops_and_readiness(spark):
    s = spark.createDataFrame(
        [(1, 1, "completed", []), (1, 2, "failed", [1]), (1, 3, "pending", [1, 2]), (1, 4, "pending", [9])],
        "session_id int, step_id int, status string, depends_on array<int>",
    )
    assert {r.step_id: r.ready for r in lineage.ready_steps(s).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_edge_without_reference(spark):
    e = spark.createDataFrame([(1, None)], "edge_id int, source_id string")
    with pytest.raises(Exception, match="names some evidence"):
        lineage.correlate(e, {"source": spark.createDataFrame([("a",)], "id string")}).collect()


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z")], "id int, v string")
    assert sorted(map(tuple, store.update(a, b, "id", ["v"]).collect())) == [(1, "x"), (2, "z")]
    with pytest.raises(ValueError):
        store.update(a, spark.createDataFrame([(3, "q")], "id int, v string"), "id", ["v"])
    store.publish(a, str(tmp_path / "t"), "v1")
    store.publish(b, str(tmp_path / "t"), "v2")
    assert store.published(spark, str(tmp_path / "t")).count() == 1
    store.replace_partition(a, str(tmp_path / "p"), "id")
    store.replace_partition(b, str(tmp_path / "p"), "id")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "x"), (2, "z")]


def test_dangerous_permissions():
    assert len(manifest.DANGEROUS) == len(set(manifest.DANGEROUS)) == 41 and all(
        p.startswith("android.permission.") for p in manifest.DANGEROUS
    )


def test_har_and_events(spark, tmp_path):
    entry = {
        "startedDateTime": "2024-01-01T00:00:00Z",
        "time": 5.0,
        "request": {
            "method": "GET", "url": "https://h/1", "headers": [{"name": "Cookie", "value": "s"}], "bodySize": -1
        },
        "response": {"status": 200, "headers": [], "bodySize": 3, "content": {"text": "abc"}},
    }
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [entry, entry]}}))
    rows = corpus.har(spark, str(tmp_path / "a.har")).collect()
    assert len(
        {r.id for r in rows}
    ) == 2 and rows[0].response_body_hash == hashlib.sha256(b"abc").hexdigest() and rows[0].request_size == 0
    lines = spark.createDataFrame(
        [('x -> {"type": "http", "metadata": {"a": {"b": 1}}, "timestamp": 1.5} y',), ("{broken",), ('{"no": 1}',)],
        "value string",
    )
    got = corpus.hook_events(lines).collect()
    assert [r.hook_type for r in got] == ["http"] and str(got[0].ts) == "1970-01-01 00:00:01.500000"


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, data in {
        "A.java": b"class A {}\r\n",
        "b.bin": b"x",
        "c.txt": b"\xff\xfe",
        "d.kt": b"",
        "e.smali": b"a\0b",
        "f.txt": b"y" * 60,
    }.items():
        (tmp_path / "src" / name).write_bytes(data)
    t = corpus.source_tree(spark, str(tmp_path / "src"), parse_limit=50)
    assert {r.path: r.state for r in t.collect()} == {
        "A.java": "indexed",
        "b.bin": "unsupported-suffix",
        "c.txt": "invalid-utf8",
        "e.smali": "binary",
        "f.txt": "fallback",
    }
    a = corpus.accounting(t).first()
    assert (a.indexed, a.skipped, a.fallback, a.warnings) == (2, 3, 1, 4)


def test_packages(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("classes.dex", b"dex")
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("classes.dex", b"dex")
        z.writestr("../evil", b"x")
        z.writestr("res/big", b"0" * (3 << 20), zipfile.ZIP_DEFLATED)
        z.writestr("META-INF/A.RSA", b"s")
        z.writestr("assets/bad", b"unhurt content")
    raw = (tmp_path / "a.apk").read_bytes().replace(b"unhurt", b"hurt!!", 1)
    (tmp_path / "a.apk").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "c.apkm", "w") as z:
        z.writestr("base.apk", inner.getvalue())
        z.writestr("split_x.apk", b"no zip")
    (tmp_path / "b.apk").write_bytes(b"no zip")
    found = packages.members(spark, str(tmp_path))
    rows = {
        (
            r.package.rsplit("/", 1)[1] if "!" not in r.package else r.package.rsplit("!", 1)[1], r.name
        ): (r.category, r.problem, r.sha256)
        for r in found.collect()
    }
    assert rows[("a.apk", "classes.dex")] == ("dex", None, hashlib.sha256(b"dex").hexdigest())
    assert rows[
        ("a.apk", "../evil")
    ][1] == "unsafe-name" and rows[("a.apk", "res/big")][:2] == ("resource", "ratio") and rows[("b.apk", None)][1] == "damaged"
    assert rows[("a.apk", "META-INF/A.RSA")][0] == "signature" and rows[("a.apk", "assets/bad")][1] == "checksum"
    assert rows[("/base.apk", "classes.dex")][0] == "dex" and rows[("/split_x.apk", None)][1] == "damaged"
    inside = packages.bundles(found)
    assert {(r.name, r.has_dex) for r in inside.collect()} == {("base.apk", True), ("split_x.apk", False)}
    assert [r.base for r in inventory.base_packages(inside).collect()] == ["base.apk"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    flow = {"id": "1", "url": "https://h/users/12", "method": "GET", "status": 200, "ts": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "a.txt").write_text(
        "noise\nFLOW:" + json.dumps(flow) + "\nFLOW:{broken\nFLOW:" + json.dumps(flow) + "\n"
    )
    flows.run_available(
        flows.once(flows.feed(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c1")
    )
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    flows.upsert_latest(
        flows.feed(spark, str(tmp_path / "in")), str(tmp_path / "up"), str(tmp_path / "c2"), ["id"], "ts"
    )
    up = str(tmp_path / "up")
    assert [r.status for r in flows.upserted(spark, up, 0, flows.FLOW).collect()] == [200]
    later = {**flow, "status": 404, "ts": "2024-01-02T00:00:00Z"}
    (tmp_path / "in" / "b.txt").write_text(
        "FLOW:" + json.dumps(later) + "\nFLOW:" + json.dumps({**flow, "id": "2"}) + "\n"
    )
    flows.upsert_latest(flows.feed(spark, str(tmp_path / "in")), up, str(tmp_path / "c2"), ["id"], "ts")
    assert {(r.id, r.status) for r in flows.upserted(spark, up, 1, flows.FLOW).collect()} == {("1", 404), ("2", 200)}


def test_hook_session_is_drained(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(
        'noise\n[d]-> {"type": "http", "class": "C", "metadata": {"a": 1}, "timestamp": 1.0}\n{broken\n'
    )
    rows = flows.drained_events(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    assert [(r.hook_type, r.class_name) for r in rows] == [("http", "C")]
