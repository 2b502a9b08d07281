"""Archives by ranges: the library's own view of small ones, 64-bit ones with holes, damage, packages within packages."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from quarrylight.sources import archives, packages, signing
from test_signing_report import apk


def small(seed, prefix=b""):
    rng, raw = random.Random(seed), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(rng.randint(0, 12)):
            data = bytes(rng.choices(range(rng.choice([2, 256])), k=rng.choice([0, 1, 5000, 300_000])))
            name = rng.choice([f"res/{i}", f"é{i}", f"dir{i}/"])
            z.writestr(zipfile.ZipInfo(name), b"" if name.endswith("/") else data, rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
        z.comment = b"c" * rng.choice([0, 70])
    return prefix + raw.getvalue()


@pytest.mark.parametrize("seed", range(12))
def test_members_are_those_of_the_library(seed):
    data = small(seed, b"#!run\n" * (seed % 3))
    file = io.BytesIO(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        got = list(archives.directory(file))
        assert [(m.filename, m.file_size, m.compress_size, m.crc) for m in got] == [(i.filename, i.file_size, i.compress_size, i.CRC) for i in z.infolist()]
        for m in got:
            assert b"".join(archives.pieces(file, m)) == z.read(m.filename)


def test_damage():
    data = bytearray(small(3))
    for broken in (b"", b"PK", bytes(data[:-30]), bytes(data[: len(data) // 2]), b"x" * 100_000):
        with pytest.raises(archives.Damaged):
            list(archives.directory(io.BytesIO(broken)))
    first = next(m for m in archives.directory(io.BytesIO(bytes(data))) if m.file_size)
    data[archives.data_start(io.BytesIO(bytes(data)), first)] ^= 255
    with pytest.raises(archives.Damaged):
        list(archives.pieces(io.BytesIO(bytes(data)), first))


def header(name, crc, small, large, flags=0, at=None):
    """A local header (at: None) or a directory entry with 64-bit fields."""
    longs = struct.pack("<HHQQ", 1, 16 + 8 * (at is not None), large, small) + (struct.pack("<Q", at) if at is not None else b"")
    common = struct.pack("<HHHHHIIIHH", 45, flags, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(longs))
    if at is None:
        return archives.LOCAL + common + name + longs
    return archives.CENTRAL + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0xFFFFFFFF) + name + longs


def test_package_of_over_four_gigabytes(spark, tmp_path):
    """A 64-bit archive with a hole of 4.5 GB: its later members and its signing block are read where they stand."""
    hole, inner, end = 4_500_000_000, apk([]), []
    entries = [(b"hole", 0, b"", hole, 1), (b"a.txt", zlib.crc32(b"hello"), b"hello", 5, 0), (b"in.apk", zlib.crc32(inner), inner, len(inner), 0)]
    signed = apk([(0x7109871A, [b"one"])])
    at = signed.rfind(signing.MAGIC) + 16
    size = struct.unpack_from("<Q", signed, at - 24)[0]
    with open(tmp_path / "large.apk", "wb") as f:
        for name, crc, data, n, flags in entries:
            end.append(header(name, crc, n, n, flags, f.tell()))
            f.write(header(name, crc, n, n, flags) + data)
            f.seek(n - len(data), 1)
        f.write(signed[at - size - 8 : at])
        start, listing = f.tell(), b"".join(end)
        f.write(listing)
        last = f.tell()
        f.write(archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 3, 3, len(listing), start))
        f.write(archives.LOCATOR64 + struct.pack("<IQI", 0, last, 1))
        f.write(archives.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with zipfile.ZipFile(tmp_path / "large.apk") as z:  # the library agrees that this is an archive
        assert z.read("a.txt") == b"hello"
    got = {(r.package.rsplit("/", 1)[1] if "!/" not in r.package else "inner", r.name): (r.size, r.sha256, r.problem) for r in packages.members(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {
        ("large.apk", "hole"): (hole, None, "encrypted"),
        ("large.apk", "a.txt"): (5, sha(b"hello"), None),
        ("large.apk", "in.apk"): (len(inner), sha(inner), None),
        ("inner", "classes.dex"): (1, sha(b"x"), None),
    }
    certificates = signing.certificates(spark, str(tmp_path)).collect()
    assert [(r.scheme, r.sha256, r.problem) for r in certificates] == [("v2", sha(b"one"), None)]


def test_members_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """However members are dealt, and whether a package within is stored or deflated: the same rows as the library gives."""
    monkeypatch.setattr(packages, "TASK_BYTES", 50_000)
    want = set()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for seed in range(6):
        data, inner = io.BytesIO(small(seed)), small(seed + 50)
        with zipfile.ZipFile(data, "a") as z:
            z.writestr("x/in.apk", inner, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)[seed % 2])
        (tmp_path / f"{seed}.zip").write_bytes(data.getvalue())
        for where, raw in ((f"{seed}.zip", data.getvalue()), (f"{seed}.zip!/x/in.apk", inner)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                want |= {(where, i.filename, i.file_size, sha(z.read(i)), None) for i in z.infolist() if not i.is_dir()}
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    want.add(("bad.zip", None, None, None, "damaged"))
    rows = packages.members(spark, str(tmp_path)).collect()
    got = {(r.package.split(str(tmp_path) + "/")[1], r.name, r.size, r.sha256, r.problem) for r in rows}
    assert got == want and len(rows) == len(want)
