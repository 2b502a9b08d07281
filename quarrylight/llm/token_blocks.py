"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents in ascending doc_id order (null ids first, equal ids by a hash of the
text), cut into blocks of 4096 ids that run across documents:

    file    b"QPF2", blocks, index, footer
    block   <u4 minimum, u1 width, u1 wide, <u2 exceptions>, then the ids less the minimum, each packed into
            `width` bits (least significant bit first), then the exceptions' positions (<u2) and what of them lies
            above `width` bits (<u4). width: the bits that all but the share `outliers` of the block's ids need; `wide` is
            kept zero.
    index   zstandard of: <u8 documents without an id (they come first, with 0 below), <u8 start of each block, <i8 doc_id
            and <u4 ids of each document
    footer  <u8 start of the index, <u8 blocks, <u8 documents, <u8 ids, <u4 crc32 of the index, b"QPF2"

Files are written under temporary names and renamed; a repeated task writes the same bytes to the same name.
A manifest table (one row for each file) makes them visible: readers open only what it lists.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.llm.common import alone, filesystem, prepare, ranges
from quarrylight.llm.encoding import encoder

MAGIC, BLOCK = b"QPF2", 4096
MANIFEST = "shard int, file string, first_doc long, last_doc long, documents long, ids long, bytes long"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, bitorder="little")[: n * width].reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_block(ids: np.ndarray, outliers: float = 0.02) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    widths = np.frexp(rest.astype(np.float64))[1]  # bits of each
    width = int(np.quantile(widths, 1 - outliers, method="higher"))
    odd = np.flatnonzero(widths > width)
    head = np.array([low], "<u4").tobytes() + bytes([width, 0]) + np.array([len(odd)], "<u2").tobytes()
    packed = pack_bits(rest & np.uint32((1 << width) - 1), width)
    return head + packed + odd.astype("<u2").tobytes() + (
        rest[odd].astype(np.uint64) >> np.uint64(width)
    ).astype("<u4").tobytes()


def decode_block(raw: memoryview, n: int) -> np.ndarray:
    low, width, odd = int(np.frombuffer(raw, "<u4", 1)[0]), raw[4], int(np.frombuffer(raw, "<u2", 1, 6)[0])
    at = 8 + (n * width + 7) // 8
    out = unpack_bits(
        np.frombuffer(raw, np.uint8, at - 8, 8), n, width
    ).astype(np.uint64) if width else np.zeros(n, np.uint64)
    where = np.frombuffer(raw, "<u2", odd, at)
    out[where] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(low)).astype("<u4")


class ShardWriter:
    def __init__(self, folder: str, shard: int, outliers: float = 0.02):
        self.fs, root = filesystem(folder)
        self.name = f"shard-{shard:06d}.qpf"
        self.temp, self.final = f"{root}/.{self.name}.{uuid.uuid4().hex}", f"{root}/{self.name}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.outliers, self.starts, self.docs, self.lengths, self.ids = 4, outliers, [], [], [], 0
        self.waiting: list[bytes] = []
        self.waits = 0

    def _flush(self, last: bool) -> None:
        raw = b"".join(self.waiting)
        step = 4 * BLOCK
        end = len(raw) if last else len(raw) - len(raw) % step
        for lo in range(0, end, step):
            block = encode_block(np.frombuffer(raw[lo : min(lo + step, end)], "<u4"), self.outliers)
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.waiting, self.waits = [raw[end:]], len(raw) - end

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.waits += len(ids)
        if self.waits >= 64 * BLOCK:
            self._flush(last=False)

    def close(self) -> tuple:
        self._flush(last=True)
        named = [d for d in self.docs if d is not None]
        nameless = len(self.docs) - len(named)
        index = zstandard.compress(
            np.array(
                [nameless, *self.starts], "<u8"
            ).tobytes() + np.array([0] * nameless + named, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes()
        )
        self.out.write(
            index
            + np.array([self.at, len(self.starts), len(self.docs), self.ids], "<u8").tobytes()
            + np.array([zlib.crc32(index)], "<u4").tobytes()
            + MAGIC
        )
        self.out.close()
        size = self.at + len(index) + 40
        self.fs.move(self.temp, self.final)
        return self.docs[0], self.docs[-1], len(self.docs), self.ids, size


def read_shard(folder: str, name: str, block_batch: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document, in order; a bounded number of blocks is held at a time."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        size = f.size()
        foot = f.read_at(40, size - 40)
        index_at, blocks, docs, ids = (int(x) for x in np.frombuffer(foot, "<u8", 4))
        raw = f.read_at(size - 40 - index_at, index_at)
        if foot[36:] != MAGIC or zlib.crc32(raw) != int(np.frombuffer(foot, "<u4", 1, 32)[0]):
            raise ValueError(f"{name} is damaged")
        index = zstandard.decompress(raw)
        nameless = int(np.frombuffer(index, "<u8", 1)[0])
        starts = [*np.frombuffer(index, "<u8", blocks, 8).tolist(), index_at]
        names, lengths = np.frombuffer(index, "<i8", docs, 8 + 8 * blocks), np.frombuffer(
            index, "<u4", docs, 8 + 8 * (blocks + docs)
        )
        have, done = np.empty(0, "<u4"), 0
        for doc, n in zip([None] * nameless + names[nameless:].tolist(), lengths.tolist()):
            if len(have) < n:
                more = [have]
                held = len(have)
                while held < n:
                    upto = min(done + block_batch, blocks)
                    buffer = memoryview(f.read_at(starts[upto] - starts[done], starts[done]))
                    for b in range(done, upto):
                        more.append(
                            decode_block(
                                buffer[starts[b] - starts[done] : starts[b + 1] - starts[done]],
                                min(BLOCK, ids - b * BLOCK),
                            )
                        )
                        held += len(more[-1])
                    done = upto
                have = np.concatenate(more)
            yield doc, have[:n]
            have = have[n:]


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    shard_bytes: int = 1 << 30,
    outliers: float = 0.02,
    id_col: str = "doc_id",
    text_col: str = "text",
    fewest: int = 16,
    least_bytes: int = 16 << 20,
) -> DataFrame:
    """Writes the files and returns their manifest, which lies in {folder}/manifest.

    shard_bytes: about how many bytes of text go to a file; fewer, but least_bytes or more, where that would give under
    `fewest` files. A null text is empty (the end id alone); rows with a null id come first and keep it; repeated rows
    are written each; further columns are not read, whatever their names. An empty table gives an empty manifest. The tokenizer
    file is opened by its path on the executors.
    """
    prepare(docs.sparkSession)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    tie = F.xxhash64("text")
    cut = ranges(source, F.col("doc_id"), F.octet_length("text") + 1, shard_bytes, fewest, least_bytes)
    placed = source.withColumns({"_shard": cut.of(F.col("doc_id"), tie), "_tie": tie})
    ranged = placed.repartitionById(cut.count, "_shard").sortWithinPartitions("_shard", "doc_id", "_tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, at = encoder(tokenizer, end_id, spaced=False).encode, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [
                    dict(
                        zip(
                            ("shard", "file", "first_doc", "last_doc", "documents", "ids", "bytes"),
                            (at, writer.name, *writer.close()),
                        )
                    )
                ],
                schema=pa.schema(
                    [
                        ("shard", pa.int32()),
                        ("file", pa.string()),
                        *((x, pa.int64()) for x in ("first_doc", "last_doc", "documents", "ids", "bytes"))
                    ]
                ),
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for doc, shard, ids in zip(
                    part.column(0).to_pylist(), part.column(2).to_pylist(), encode(part.column(1).to_pylist())
                ):
                    if shard != at:
                        if writer:
                            yield done()
                        writer, at = ShardWriter(folder, shard, outliers), shard
                    writer.add(doc, ids)
        if writer:
            yield done()

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary), from the files that the manifest lists.

    The manifest, one row for each file, passes through the driver; each file is read by a task of its own.
    """
    rows = prepare(spark).read.schema(MANIFEST).parquet(f"{folder}/manifest").select(
        "shard", "file", "ids"
    ).orderBy("shard").collect()
    base = np.cumsum([0, *(r.ids for r in rows)]).tolist()
    listed = spark.createDataFrame(
        [(i, r.file, b) for i, (r, b) in enumerate(zip(rows, base))], "number int, file string, base long"
    )
    files = listed.repartitionById(max(1, len(rows)), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for row in batch.to_pylist():
                at, out, size = row["base"], [], 0
                for doc, ids in read_shard(folder, row["file"]):
                    out.append((doc, at, len(ids), ids.tobytes()))
                    at, size = at + len(ids), size + 4 * len(ids)
                    if size > 8_000_000:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"]
    )
