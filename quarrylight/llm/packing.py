"""Vector bin packing of examples into training sequences.

Every example asks for three things at once: tokens, a segment, and loss-bearing tokens. A sequence
holds a bounded amount of each. Sequences are filled one after the other: of the waiting examples that
still fit in every dimension, the one with the largest dot product of its demand and what is left of the
sequence goes in (each dimension scaled by its limit and weighted by the mean demand for it). When none
fits whole, one is cut so that the sequence is full; so are examples larger than a sequence.

Each Spark partition packs its own rows from a bounded pool of waiting examples, so nothing is shuffled
and memory does not grow with the input. What is left at the end of a partition goes into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.llm.common import prepare
from quarrylight.llm.encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
#: Bits of sequence_id that count sequences in a partition.
COUNTER_BITS = 33
#: Pieces of text that each Python worker remembers the ids of: nothing is shuffled, so there is memory for many.
REMEMBER = 1_200_000


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


def behind_first_line(text: Column) -> Column:
    """The share of a text's bytes behind its first line feed; 1 for a text of one line: the first line counts as the prompt."""
    at = F.instr(text, "\n")
    size = F.octet_length(text)
    return F.when(at > 0, 1 - F.octet_length(F.left(text, at)) / F.greatest(size, F.lit(1))).otherwise(F.lit(1.0))


class Pool:
    """Waiting examples. `fill` places some of them into one sequence."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.docs: list[tuple] = []  # (doc_id, ids, doc_tokens)
        self.length = np.empty(0, np.int64)  # tokens left of each, loss tokens of these, tokens placed before
        self.loss = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)

    def add(self, rows: list[tuple], loss: list[int]) -> None:
        live = self.length > 0
        self.docs = [d for d, x in zip(self.docs, live) if x] + rows
        n = np.array([r[2] for r in rows], np.int64)
        self.length = np.concatenate([self.length[live], n])
        self.loss = np.concatenate([self.loss[live], np.clip(np.array(loss, np.int64), 0, n)])
        self.start = np.concatenate([self.start[live], np.zeros(len(rows), np.int64)])

    @property
    def tokens(self) -> int:
        return int(self.length.sum())

    def _fits(self, i: int, room: int, loss_room: int) -> int:
        """Tokens of example i that fit: the loss-bearing ones are its last."""
        return min(int(self.length[i]), room, int(self.length[i] - self.loss[i]) + loss_room)

    def fill(self, capacity: int) -> list[tuple]:
        """(doc index, start, length, loss tokens) of the pieces of one sequence of `capacity` tokens."""
        room, segments, loss_room = capacity, self.limits.segments, self.limits.loss_tokens
        live = self.length > 0
        n = max(1, int(live.sum()))
        weight, loss_weight = self.length.sum() / n / self.limits.tokens, self.loss.sum() / n / self.limits.loss_tokens
        out: list[tuple] = []
        while room and segments:
            a, b = weight * room / self.limits.tokens**2, loss_weight * loss_room / self.limits.loss_tokens**2
            score = a * self.length + b * self.loss
            whole = np.where((self.length > 0) & (self.length <= room) & (self.loss <= loss_room), score, -1.0)
            i = int(whole.argmax()) if len(whole) else 0
            if not len(whole) or whole[i] < 0:  # none fits whole: cut the one that asks for most
                score = np.where((self.length > 0) & ((self.length > self.loss) | (loss_room > 0)), score, -1.0)
                if not len(score) or score[i := int(score.argmax())] < 0:
                    break
            k = self._fits(i, room, loss_room)
            kept = min(int(self.loss[i]), int(self.length[i]) - k)  # loss-bearing tokens left behind
            out.append((i, int(self.start[i]), k, int(self.loss[i]) - kept))
            room, segments, loss_room = room - k, segments - 1, loss_room - out[-1][3]
            self.length[i], self.loss[i], self.start[i] = self.length[i] - k, kept, self.start[i] + k
        return out


def sequences(
    rows: Iterator[tuple[list[tuple], list[int]]], limits: Limits, pool_rows: int = 1024
) -> Iterator[list[tuple]]:
    """The pieces of one sequence after the other, as (doc_id, start, length, ids, doc_tokens, loss tokens, offset)."""
    pool = Pool(limits)

    def take(capacity: int) -> list[tuple]:
        at, out = 0, []
        for i, start, k, loss in pool.fill(capacity):
            doc, ids, n = pool.docs[i]
            out.append((doc, start, k, ids[4 * start : 4 * (start + k)], n, loss, at))
            at += k
        return out

    for some, loss in rows:
        for lo in range(0, len(some), pool_rows):
            pool.add(some[lo : lo + pool_rows], loss[lo : lo + pool_rows])
            keep = min(pool.tokens // 4, limits.tokens * 64)  # some stay, so that later sequences have a choice
            left = pool.tokens
            while left > max(keep, limits.tokens):
                yield (got := take(limits.tokens))
                left -= sum(x[2] for x in got)
    while left := pool.tokens:
        yield take(limits.tokens if left >= limits.tokens else 1 << (left.bit_length() - 1))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    loss_share: Column | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, start (ids of its document before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (with the end id), loss_tokens, sequence_id, offset.

    loss_col: how many of an example's last tokens bear loss, as in instruction data; loss_share: instead, which share of its
    tokens (0 to 1, rounded up). Null or neither: all. A null text is empty and gives the end id alone. Repeated rows are
    packed each; a null id stays null; further columns are not read, whatever their names. An empty table gives no row.
    """
    prepare(docs.sparkSession)
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    share = F.lit(None).cast("double") if loss_share is None else loss_share.cast("double")
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        loss.alias("loss"),
        share.alias("share"),
    )
    fields = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("loss_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64())
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, end_id, spaced=True, remember=REMEMBER).encode
        first = TaskContext.get().partitionId() << COUNTER_BITS

        def rows() -> Iterator[tuple[list[tuple], list[int]]]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    ids = encode(part.column(1).to_pylist())
                    lengths = [len(x) // 4 for x in ids]
                    loss = [
                        x if x is not None else n if s is None else -int(-n * s // 1) for n, x, s in zip(
                            lengths, part.column(2).to_pylist(), part.column(3).to_pylist()
                        )
                    ]
                    yield list(zip(part.column(0).to_pylist(), ids, lengths)), loss

        out: list[tuple] = []
        for number, pieces in enumerate(sequences(rows(), limits)):
            out += [(*p[:6], first + number, p[6]) for p in pieces]
            if len(out) >= 4000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields
                )
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields)

    return source.mapInArrow(run, SCHEMA)
