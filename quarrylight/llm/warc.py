"""A deterministic sharded WARC/1.1 writer, and its reader.

Records are put in order of a key by ranges whose bounds depend on the rows alone, and sorted within them.
Each range writes gzip members, one for each record, into files that roll over at a compressed size.
Headers, record ids and digests are made anew from the payload. Files get temporary names and are renamed when
complete, so a repeated task replaces a file by the same bytes; a manifest table, written last, says
which files there are. Readers open only these and check each file's size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.llm.common import filesystem, prepare, ranges, written

MANIFEST = "shard int, number int, file string, records long, bytes long, first_key long, last_key long"
RECORD = "record_id string, record_type string, target_uri string, key long, refers_to string, payload_digest string, payload_bytes long, payload binary"
_SPACE = uuid.UUID("7b7c8e52-6d7f-5a5e-9a55-3f1f0c7f7a11")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{payload_digest}')}>"


def _header(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def record(
    kind: str, key: int | None, url: str | None, payload: bytes, date: str, refers: tuple[int, str | None] | None
) -> bytes:
    """One WARC record. A revisit has the HTTP headers only; Content-Length of these tells the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, own = http + (payload if kind == "response" else b""), digest(payload)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(key, own)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Record-Key", "" if key is None else str(key))
    ]
    if refers:
        head += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id(refers[0], own)),
            ("WARC-Refers-To-Target-URI", _header(refers[1])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Key", str(refers[0]))
        ]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head)).encode() + b"\r\n" + block + b"\r\n\r\n"


class RollingWriter:
    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int):
        self.fs, self.root = filesystem(folder)
        self.shard, self.roll_bytes, self.level, self.number, self.out = shard, roll_bytes, level, -1, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, key: int | None, raw: bytes) -> dict | None:
        """The manifest row of the file that this record's arrival closes."""
        done = self.close() if self.out is not None and self.size >= self.roll_bytes else None
        if self.out is None:
            self.number += 1
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.first = self.fs.open_output_stream(self.temp), 0, 0, key
        member = gzip.compress(raw, self.level, mtime=0)
        self.out.write(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, key
        return done

    def close(self) -> dict:
        self.out.close()
        self.out = None
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        return {
            "shard": self.shard,
            "number": self.number,
            "file": self.name,
            "records": self.records,
            "bytes": self.size,
            "first_key": self.first,
            "last_key": self.last,
        }


def write_warc(
    pages: DataFrame,
    folder: str,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = 4 << 30,
    roll_bytes: int = 1 << 30,
    revisit_bytes: int | None = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 6,
    fewest: int = 64,
    least_bytes: int = 4 << 20,
) -> DataFrame:
    """Writes one record for each row and returns the manifest, which lies in {folder}/manifest.

    revisit_bytes: of records with equal payloads of at least so many bytes, the one with the largest key is the
    response and the others are revisits of it (None: all are responses). Where that key has several rows,
    all of these are responses. shard_bytes: about how much payload goes to a range (less, but least_bytes or
    more, where that would give under `fewest` ranges); roll_bytes: compressed size at which a file is full. Records are in the
    order of key, then of a hash of payload and url. A null payload is empty, a null key comes first and is never referred
    to, a null url is an empty header. Further columns are not read, whatever their names. An empty table gives an empty manifest.
    """
    spark = prepare(pages.sparkSession)
    source = pages.select(
        F.col(key_col).cast("long").alias("key"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    size = F.octet_length("payload")
    again = source.where(F.lit(revisit_bytes is not None) & (size >= (revisit_bytes or 0))).groupBy("sha").agg(
        F.max_by(F.struct("key", "url"), "key").alias("ref"), F.count("*").alias("n")
    ).where("n > 1 and ref.key is not null").select("sha", "ref")
    again = written(again, "payloads")  # so that Spark sees its size: pages are shuffled for it only if it is large
    joined = source.join(again, "sha", "left").select(
        "key",
        "url",
        "payload",
        "sha",
        F.when(F.col("key").isNull() | (F.col("key") < F.col("ref.key")), F.col("ref")).alias("ref"),
    )
    cut = ranges(source, F.col("key"), size + 500, shard_bytes, fewest, least_bytes)  # headers have about 500 bytes
    tie = F.xxhash64("sha", "url")
    placed = joined.withColumns({"_shard": cut.of(F.col("key"), tie), "_tie": tie})
    ranged = placed.repartitionById(cut.count, "_shard").sortWithinPartitions("_shard", "key", "_tie", "url", "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None or writer.shard != r["_shard"]:
                    if writer:
                        rows.append(writer.close())
                    writer = RollingWriter(folder, r["_shard"], roll_bytes, level)
                ref = r["ref"]
                kind = "revisit" if ref else "response"
                if done := writer.add(
                    r["key"],
                    record(kind, r["key"], r["url"], r["payload"], date, (ref["key"], ref["url"]) if ref else None),
                ):
                    rows.append(done)
        if writer:
            rows.append(writer.close())
        if rows:
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        ("shard", pa.int32()),
                        ("number", pa.int32()),
                        ("file", pa.string()),
                        *((c, pa.int64()) for c in ("records", "bytes", "first_key", "last_key"))
                    ]
                ),
            )

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names lower-cased), HTTP header bytes and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(named["content-length"])]
    if named["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"{named['warc-record-id']}: block digest does not match")
    http, _, body = block.partition(b"\r\n\r\n")
    return named, http, body


def members(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, one after the other."""
    data, out, one = b"", [], zlib.decompressobj(31)
    while True:
        data = data or f.read(chunk)
        if not data:
            if out or not one.eof and one.unconsumed_tail:
                raise ValueError("the file ends within a record")
            return
        out.append(one.decompress(data))
        data = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(out)
            out, one = [], zlib.decompressobj(31)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files that the manifest lists. payload is null for revisits;
    payload_digest (bare) and payload_bytes are of the full payload, checked against it where it is there.
    The manifest's file names pass through the driver; each file is read by a task of its own. An empty manifest gives no row."""
    listed = prepare(spark).read.schema(MANIFEST).parquet(
        f"{folder}/manifest"
    ).select("file", "records").orderBy("file").collect()
    rows = [(i, r.file, r.records) for i, r in enumerate(listed)]
    files = spark.createDataFrame(rows, "at int, file string, records long").repartitionById(max(1, len(rows)), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for file in batch.to_pylist():
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{root}/{file['file']}", compression=None) as f:
                    for raw in members(f):
                        named, http, body = parse(raw)
                        size, own = int(
                            http.rpartition(b"Content-Length:")[2]
                        ), named["warc-payload-digest"].removeprefix("sha1:")
                        if (full := named["warc-type"] == "response") and (len(body), digest(body)) != (size, own):
                            raise ValueError(f"{named['warc-record-id']}: payload does not match its headers")
                        key, ref = named["x-record-key"], named.get("x-refers-to-key")
                        rows.append(
                            (
                                named["warc-record-id"],
                                named["warc-type"],
                                named["warc-target-uri"],
                                int(key) if key else None,
                                ref,
                                own,
                                size,
                                body if full else None,
                            )
                        )
                        seen, held = seen + 1, held + len(body)
                        if held > 8_000_000 or len(rows) >= 4000:
                            yield _table(rows)
                            rows, held = [], 0
                if seen != file["records"]:
                    raise ValueError(f"{file['file']} has {seen} records; the manifest says {file['records']}")
                if rows:
                    yield _table(rows)

    return files.mapInArrow(run, RECORD)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(zip(*rows), (s, s, s, n, s, s, n, pa.binary()))],
        names=[c.split()[0] for c in RECORD.split(", ")],
    )
