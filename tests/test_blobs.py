"""The blob store: one blob for a content over repeated and parallel imports, damage that is found, nothing half written."""

import hashlib
import os

from quarrylight.operators import blobs

SHA = lambda x: hashlib.sha256(x).hexdigest()


def stored(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_import_repeat_and_damage(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    data = {"a.txt": b"one", "b.bin": b"two" * 700_000, "c.txt": b"one", "e.apk": b""}
    for name, content in data.items():
        (src / name).write_bytes(content)
    rows = [("p1", str(src / n)) for n in data] * 3 + [("p2", str(src / "a.txt")), ("../x", str(src / "a.txt")), ("p1", str(src / "none")), ("p1", str(src)), ("p1", None)]
    files = spark.createDataFrame(rows, "project_id string, path string").repartition(6)
    want = sorted(f"{p}/{SHA(c)[:2]}/{SHA(c)}/blob" for p, c in {("p1", b"one"), ("p1", data["b.bin"]), ("p1", b""), ("p2", b"one")})
    for again in (False, True):
        got = blobs.import_files(files, root).collect()
        assert len(got) == len(rows) and stored(root) == want
        for r in got:
            name = os.path.basename(r.source or "")
            if r.project_id == "../x":
                assert r.state == "refused"
            elif name not in data:
                assert r.state == "missing" and r.stored_path is None
            else:
                assert (r.sha256, r.size) == (SHA(data[name]), len(data[name])) and r.stored_path in want
                assert r.state in (("known",) if again else ("new", "known"))
    assert {r.state for r in blobs.check(spark, root).collect()} == {"ok"}
    bad = os.path.join(root, want[0])
    open(bad, "ab").write(b"x")
    found = {r.stored_path: r.state for r in blobs.check(spark, root).collect()}
    assert [p for p, s in found.items() if s == "damaged"] == [want[0]] and len(found) == 3  # Spark lists no empty file
    assert {r.state for r in blobs.import_files(files, root).collect() if r.stored_path == want[0]} == {"damaged"}
    assert not os.listdir(os.path.join(root, blobs.STAGING))


def test_a_killed_copy_leaves_no_blob(tmp_path, monkeypatch):
    root, source = str(tmp_path / "store"), tmp_path / "f"
    source.write_bytes(b"x" * 100)
    real = blobs._pieces

    def dying(where, path):
        for piece in real(where, path):
            yield piece[:10]
            raise KeyboardInterrupt

    monkeypatch.setattr(blobs, "_pieces", dying)
    try:
        blobs.place(root, "p", str(source))
    except KeyboardInterrupt:
        pass
    assert stored(root) == []
    monkeypatch.setattr(blobs, "_pieces", real)
    assert blobs.place(root, "p", str(source))[2] == "new" and blobs.place(root, "p", str(source))[2] == "known"


def test_packages_changed_since_inspection(spark, tmp_path):
    for n, c in (("a.apk", b"a"), ("b.apk", b"b")):
        (tmp_path / n).write_bytes(c)
    rows = [("p", str(tmp_path / "a.apk"), 1, SHA(b"a")), ("p", str(tmp_path / "b.apk"), 1, SHA(b"old")), ("p", str(tmp_path / "c.apk"), 1, SHA(b"c"))]
    inspected = spark.createDataFrame(rows, "project_id string, path string, size long, sha256 string")
    got = blobs.import_packages(spark, inspected, str(tmp_path / "rows"), str(tmp_path / "store")).collect()
    assert {os.path.basename(r.path): r.state for r in got} == {"a.apk": "imported", "b.apk": "changed", "c.apk": "missing"}
