"""Signing blocks built by hand, and Markdown reports."""

import hashlib
import io
import struct
import zipfile

from quarrylight.operators import report
from quarrylight.sources import archives, signing


def part(x):
    return struct.pack("<I", len(x)) + x


def apk(schemes, broken=False):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("classes.dex", b"x")
    data = raw.getvalue()
    end = data.rfind(archives.END)
    (directory,) = struct.unpack_from("<I", data, end + 16)
    pairs = b""
    for key, certs in schemes:
        signed = part(part(struct.pack("<I", 0x103) + part(b"d"))) + part(b"".join(map(part, certs)))
        bounds = b"" if key == 0x7109871A else struct.pack("<II", 28, 33)
        value = part(part(part(signed) + bounds + part(part(struct.pack("<I", 0x104) + part(b"s"))) + part(b"key")))
        pairs += struct.pack("<QI", len(value) + 4, key) + value
    size = len(pairs) + 24
    block = struct.pack("<Q", size + broken) + pairs + struct.pack("<Q", size) + signing.MAGIC
    moved = bytearray(data[end:])
    struct.pack_into("<I", moved, 16, directory + len(block))
    return data[:directory] + block + data[directory:end] + bytes(moved)


def test_certificates(spark, tmp_path):
    (tmp_path / "a.apk").write_bytes(
        apk([(0x7109871A, [b"one", b"two"]), (0xF05368C0, [b"three"]), (0x42, [b"padding"])])
    )
    (tmp_path / "b.apk").write_bytes(apk([(0x7109871A, [b"one"])], broken=True))
    (tmp_path / "c.apk").write_bytes(apk([]))
    (tmp_path / "d.apk").write_bytes(b"no archive")
    rows = signing.certificates(spark, str(tmp_path)).collect()
    got = {(r.scheme, r.signer, r.certificate): (r.sha256, r.digests, r.signatures) for r in rows if r.problem is None}
    h = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {
        ("v2", 0, 0): (h(b"one"), [0x103], [0x104]),
        ("v2", 0, 1): (h(b"two"), [0x103], [0x104]),
        ("v3", 0, 0): (h(b"three"), [0x103], [0x104]),
    }
    assert sorted((r.package.rsplit("/", 1)[1], r.problem) for r in rows if r.problem) == [
        ("a.apk", "unknown-block-0x00000042"), ("b.apk", "malformed"), ("d.apk", "no-archive")
    ]


def test_report(spark):
    df = spark.createDataFrame([(i, f"a|b\n{i}" if i else None) for i in range(5)], "k int, v string")
    table = report.markdown_table(df, ["k", "v"], ["k"], most=2)
    text, digest = report.render("T", [("Rows", table), ("None", report.markdown_table(df.limit(0), ["k"], ["k"]))])
    assert text == "# T\n\n## Rows\n\n| k | v |\n|---|---|\n| 0 | - |\n| 1 | a\\|b 1 |\n\n3 more rows are not shown.\n\n## None\n\nNothing was found.\n"
    assert digest == hashlib.sha256(text.encode()).hexdigest()
