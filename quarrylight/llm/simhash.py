"""SimHash near-duplicates: exact search within a Hamming radius by tiled comparison.

Fingerprints that differ in at most r bits agree on at least m - r of m blocks of bits, so every distinct
fingerprint is filed under each choice of m - r blocks and compared within its files only: no link is
lost. A file is compared tile by tile with numpy's exclusive-or and bit counts, fingerprints sorted by their
population count; a pair of tiles whose counts differ by more than r is skipped. A large file is dealt by
hash into parts and each pair of parts is a group of its own, so no task gets an unbounded group. Only a
spanning forest of each group's links leaves it. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarrylight.llm.common import prepare, written
from quarrylight.llm.components import connected_components

BITS, TILE = 64, 512
#: Fingerprints in a file that more blocks would make smaller.
MOST = 1024


def hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included: words between ASCII white space, A-Z lower-cased; fewer words make one."""
    words = text.lower().split() if text else []
    joined, shingle = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist() if words else []
    ends = end[shingle - 1 :].tolist() if words else []
    for lo in range(0, len(start), 1 << 16):
        some = map(joined.__getitem__, map(slice, start[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64)


def majority(parts: list[np.ndarray]) -> int:
    """Bits that are set in over half of the hashes."""
    total, n = np.zeros(BITS, np.int64), sum(map(len, parts))
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Of a whole text, unsigned; a text without words has 0."""
    return majority(list(hashes(text, shingle, seed)))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42
) -> DataFrame:
    """(doc_id, tie, fp) of every row: fp as a signed long, tie a hash of the text. A null text counts as empty.

    Repeated rows each come back; an empty table gives no row; further columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array(
                [fingerprint(t, shingle, seed) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], names=["doc_id", "tie", "fp"]
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")
    )
    return source.mapInArrow(run, "doc_id long, tie long, fp long")


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives what the links (x, y) join one label, in place. A label is the position of a member that has it."""
    while len(x):
        u, v = label[x], label[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label[:] = label[label]


def forest(fp: np.ndarray, part: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) that connect what links of at most `radius` bits connect. With two parts: links between them only."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    f, own = fp[order], part[order]
    pop, cross = np.bitwise_count(f).astype(np.int64), bool(len(part)) and part.min() != part.max()
    label = np.arange(len(f))
    for i in range(0, len(f), TILE):
        a = slice(i, min(i + TILE, len(f)))
        for j in range(i, len(f), TILE):
            b = slice(j, min(j + TILE, len(f)))
            if pop[j] - pop[a.stop - 1] > radius:
                break
            if (label[a] == label[i]).all() and (label[b] == label[i]).all():
                continue  # connected already: in a large group of copies most tiles are
            near = np.bitwise_count(f[a, None] ^ f[None, b]) <= radius
            if cross:
                near &= own[a, None] != own[None, b]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            merge(label, x[x < y], y[x < y])
    far = np.flatnonzero(label != np.arange(len(f)))
    return order[far], order[label[far]]


def by_group(batches: Iterator[pa.RecordBatch], width: int, names: int) -> Iterator[np.ndarray]:
    """The rows (longs) of each group after the other; a group has equal first `names` columns and its rows side by side."""
    held = np.empty((0, width), np.int64)
    for batch in batches:
        rows = np.column_stack(
            [batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
        ).astype(np.int64, copy=False)
        rows = np.concatenate([held, rows])
        edges = [0, *(np.flatnonzero((rows[1:, :names] != rows[:-1, :names]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield rows[lo:hi]
        held = rows[edges[-1] :]  # the last group may go on
    if len(held):
        yield held


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
            )

        for rows in by_group(batches, 5, 3):  # file, p, q, part, fp
            if len(rows) > 1:
                bits = np.ascontiguousarray(rows[:, 4])
                x, y = forest(bits.view(np.uint64), rows[:, 3], radius)
                if len(x):
                    a.append(bits[x])
                    b.append(bits[y])
                    held += len(x)
            if held > 100_000:
                yield table()
                a, b, held = [], [], 0
        if held:
            yield table()

    return run


def blocks_for(nodes: int, radius: int, most: int) -> int:
    """The fewest blocks with which a file of evenly spread fingerprints stays under `most`."""
    m = radius + 1
    while m < 3 * radius and nodes >> (BITS * (m - radius) // m) > most:
        m += 1
    return m


def _files(fp: F.Column, m: int, radius: int) -> list[F.Column]:
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    out = []
    for number, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(masks[i] for i in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        # files that a hash throws together only add comparisons
        out.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return out


def deal(filed: DataFrame, size: int, spread: list[str]) -> DataFrame:
    """filed (file, ...) with p, q and part: files of over `size` rows are dealt by the hash of `spread` into parts, and each
    pair of parts is a group (file, p, q). A row goes to as many groups as its file has parts."""
    parts = filed.groupBy("file").agg(F.count("*").alias("_rows")).where(F.col("_rows") > size).select(
        "file", F.ceil(F.col("_rows") / size).alias("k")
    )
    dealt = filed.join(parts, "file", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*spread, F.lit(7)), F.col("k")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("k", "other")


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes: (fp), distinct. Links (a, b) of fingerprints that connect what fingerprints within the radius connect.

    No nodes give no link. A fingerprint has as many rows as there are choices of blocks: 5 with radius 4, 15 when files
    of evenly spread ones would pass MOST, and so on.
    """
    m = blocks_for(nodes.count(), radius, MOST)
    filed = nodes.select("fp", F.explode(F.array(*_files(F.col("fp"), m, radius))).alias("file"))
    grouped = deal(filed, 2 * MOST, ["fp"]).select("file", "p", "q", "part", "fp")
    return grouped.repartition("file", "p", "q").sortWithinPartitions("file", "p", "q").mapInArrow(
        _links(radius), "a long, b long"
    )


def near_duplicates(
    docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4
) -> DataFrame:
    """(doc_id, tie, fp, node, component_id) of every row. node: the same for all rows of a group that links connect;
    component_id: the group's least doc_id, null if none has one. tie: a hash of the text.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each come back. An empty table
    gives no row. Further columns are not read, whatever their names.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes.select("fp"), radius))
    joined = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("node")
    )
    least = joined.groupBy("node").agg(F.min("rep").alias("component_id"))
    return marked.join(
        joined.join(least, "node").select("fp", "node", "component_id"), "fp"
    ).select("doc_id", "tie", "fp", "node", "component_id")
