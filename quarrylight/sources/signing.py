"""Certificates in APK signing blocks (schemes 2, 3 and 3.1) as rows: fingerprints only, nothing is verified."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylight.session import for_workers
from quarrylight.sources.archives import Damaged, ends, opened

SIGNER = "package string, scheme string, signer int, certificate int, sha256 string, bytes long, digests array<long>, signatures array<long>, problem string"
# Fixed values of the format: its magic, and the ids of the schemes.
MAGIC = b"APK Sig Block 42"
SCHEMES = {0x7109871A: "v2", 0xF05368C0: "v3", 0x1B93AD61: "v3.1"}
PADDING = 0x42726577
#: A signing block is held whole, up to this size.
MOST_BLOCK = 64 << 20


def _part(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """What a 32-bit length stands before, and where it ends."""
    (n,) = struct.unpack_from("<I", data, at)
    if at + 4 + n > len(data):
        raise ValueError("malformed")
    return data[at + 4 : at + 4 + n], at + 4 + n


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        x, at = _part(data, at)
        out.append(x)
    return out


def _algorithms(data: bytes) -> list[int]:
    return [struct.unpack_from("<I", x)[0] for x in _parts(data)]


def block(file) -> dict[int, bytes]:
    """The signing block's values by id; none if there is no block. Of the file only its end and the block are read."""
    try:
        directory = ends(file).start
    except Damaged:
        raise ValueError("no-archive") from None
    if directory < 32:
        return {}
    file.seek(directory - 24)
    foot = file.read(24)
    if foot[8:] != MAGIC:
        return {}
    (size,) = struct.unpack_from("<Q", foot)
    start = directory - size - 8
    if start < 0:
        raise ValueError("malformed")
    if size > MOST_BLOCK:
        raise ValueError("too-large")
    file.seek(start)
    data = file.read(size + 8 - 24)  # without its foot
    if struct.unpack_from("<Q", data)[0] != size:
        raise ValueError("malformed")
    out, at = {}, 8
    while at < len(data):
        n, key = struct.unpack_from("<QI", data, at)
        if n < 4 or at + 8 + n > len(data):
            raise ValueError("malformed")
        out[key] = data[at + 12 : at + 8 + n]
        at += 8 + n
    return out


def signers(values: dict[int, bytes]) -> list[tuple]:
    """(scheme, signer, certificate, sha256, bytes, digest algorithms, signature algorithms) of a block's values."""
    out = []
    for key, value in values.items():
        if key not in SCHEMES:
            continue
        for i, signer in enumerate(_parts(_part(value)[0])):
            signed, at = _part(signer)
            # later schemes have SDK bounds between
            signatures = _algorithms(_part(signer, at + (0 if key == 0x7109871A else 8))[0])
            digests, at = _part(signed)
            for j, c in enumerate(_parts(_part(signed, at)[0])):
                out.append(
                    (SCHEMES[key], i, j, hashlib.sha256(c).hexdigest(), len(c), _algorithms(digests), signatures)
                )
    return out


def unknown(values: dict[int, bytes]) -> list[int]:
    """Ids of a block's values that are neither a scheme's nor padding."""
    return sorted(k for k in values if k not in SCHEMES and k != PADDING)


def certificates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each certificate of each signer of every package below path; one with a problem for a broken block
    and for each value of a block that no known scheme has (unknown-block and its id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SIGNER.split(", ")]
        longs = pa.list_(pa.int64())
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), longs, longs, pa.string())
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as file:
                        values = block(file)
                    rows += [(name, *x, None) for x in signers(values)]
                    rows += [(name, *[None] * 7, f"unknown-block-{k:#010x}") for k in unknown(values)]
                except (ValueError, struct.error) as e:
                    rows.append((name, *[None] * 7, str(e) if isinstance(e, ValueError) else "malformed"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows) if rows else ([],) * 9, kinds)], names=names
            )

    return for_workers(spark).read.format("binaryFile").option(
        "recursiveFileLookup", "true"
    ).load(path).select("path").mapInArrow(run, SIGNER)
