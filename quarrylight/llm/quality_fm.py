"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

so a text is scored in time linear in its distinct words. The machine is fitted by Adam to a sample of labelled
rows whose size has a documented bound (max_rows, taken by the hash of the id); scoring reads every row in
one scan without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrylight.llm.common import alone, fresh, map_in_arrow, prepare

SYMBOLS, UPPER, DIGITS, ENDS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
STATISTICS = (
    "log_words",
    "word_length",
    "symbols",
    "upper",
    "digits",
    "exclaims",
    "distinct_words",
    "top_word",
    "repeated_lines",
    "line_words",
    "symbol_words",
    "not_ascii",
)


def statistics(raw: bytes, words: Counter) -> list[float]:
    """Of a text's UTF-8 bytes and its words; all are shares or logarithms."""
    n, size = sum(words.values()), max(1, len(raw))
    gone = lambda some: (len(raw) - len(raw.translate(None, some))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(k for w, k in words.items() if w[-1:] in SYMBOLS_SET) / max(1, n)
    return [
        np.log1p(n),
        np.log1p(size / max(1, n)),
        gone(SYMBOLS),
        gone(UPPER),
        gone(DIGITS),
        gone(ENDS),
        len(words) / max(1, n) if n else 0.0,
        max(words.values(), default=0) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        np.log1p(n / max(1, len(lines))),
        marked,
        1 - len(raw.decode("utf-8", "ignore")) / size
    ]


SYMBOLS_SET = frozenset(bytes([x]) for x in SYMBOLS)


def features(text: bytes | None, buckets: int) -> tuple[list[int], float, list[float]]:
    """Buckets of the distinct words, the value each has (their vector has length 1/2), and the statistics."""
    raw = text or b""
    words = Counter(raw.split())
    hashed = [zlib.crc32(w) % buckets for w in words]
    return hashed, 0.5 / np.sqrt(len(hashed)) if hashed else 0.0, statistics(raw, words)


@dataclass
class Machine:
    buckets: int
    bias: float
    linear: np.ndarray  # buckets, then statistics, then metadata
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of each row; index, value and row are parallel."""
        out = self.bias + np.bincount(row, self.linear[index] * value, rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f] * value
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out

    def assemble(
        self, words: list[list[int]], weight: list[float], dense: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, wide = len(words), dense.shape[1]
        size = np.fromiter(map(len, words), np.int64, rows)
        index = np.concatenate(
            [
                np.fromiter((b for w in words for b in w), np.int64, int(size.sum())),
                np.tile(self.buckets + np.arange(wide), rows)
            ]
        )
        value = np.concatenate(
            [
                np.repeat(np.array(weight, float), size),
                (np.clip((dense - self.mean) / self.scale, -6, 6) / np.sqrt(wide) * 2).ravel()
            ]
        )
        return index, value, np.concatenate([np.repeat(np.arange(rows), size), np.repeat(np.arange(rows), wide)])


def fit(
    words: list[list[int]],
    weight: list[float],
    dense: np.ndarray,
    label: np.ndarray,
    buckets: int,
    factors: int = 4,
    epochs: int = 12,
    batch: int = 128,
    least_steps: int = 500,
    rate: float = 0.02,
    decay: float = 1e-3,
    seed: int = 1,
) -> Machine:
    rng = np.random.default_rng(seed)
    total = buckets + dense.shape[1]
    base = np.clip(label.mean(), 0.01, 0.99)
    m = Machine(
        buckets,
        float(np.log(base / (1 - base))),
        np.zeros(total),
        rng.normal(0, 0.02, (total, factors)),
        dense.mean(axis=0),
        dense.std(axis=0) + 1e-6,
    )
    held = [np.zeros((2, total)), np.zeros((2, total, factors)), np.zeros(2)]
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(label)))):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            index, value, row = m.assemble([words[i] for i in some], [weight[i] for i in some], dense[some])
            p = 1 / (1 + np.exp(-np.clip(m.score(index, value, row, len(some)), -30, 30)))
            g = ((p - label[some]) / len(some))[row]
            sums = [np.bincount(row, m.factors[index, f] * value, len(some)) for f in range(factors)]
            grads = [
                np.bincount(index, g * value, total) + decay * m.linear / len(order),
                np.column_stack(
                    [
                        np.bincount(index, g * value * (s[row] - m.factors[index, f] * value), total) for f,
                        s in enumerate(sums)
                    ]
                ) + decay * m.factors / len(order),
                np.array((p - label[some]).mean())
            ]
            step += 1
            new = []
            for h, d in zip(held, grads):
                h[0], h[1] = 0.9 * h[0] + 0.1 * d, 0.999 * h[1] + 0.001 * d * d
                new.append(rate * (h[0] / (1 - 0.9**step)) / (np.sqrt(h[1] / (1 - 0.999**step)) + 1e-8))
            m.linear, m.factors, m.bias = m.linear - new[0], m.factors - new[1], m.bias - float(new[2])
    return m


def _numbers(meta: tuple[Column, ...]) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in meta]).cast("array<double>")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    meta: tuple[Column, ...] = (),
    max_rows: int = 6000,
    buckets: int = 1 << 14,
    **options
) -> Machine:
    """Fits to at most max_rows labelled rows: for each label max_rows / 2 ids at most, those of least hash, and of the rows
    with these ids those of least hash of id and text.

    meta: metadata of docs as numbers, null as 0. Rows without a label or an id are left out; of several labels of an id the
    lesser is taken. With no labelled row, or with one label only, the machine scores every text by the labels' mean.
    Further columns are not read, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")
    ).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    order = F.xxhash64("_id")
    some = known.where("_label = 0").orderBy(order, "_id").limit(max_rows // 2).union(
        known.where("_label = 1").orderBy(order, "_id").limit(max_rows // 2)
    )
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("t"), _numbers(meta).alias("m"))
    rows = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id"))  # max_rows ids at most
    rows = rows.orderBy(order, "_id", F.xxhash64("t")).limit(max_rows).select("_id", "t", "_label", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, buckets) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()),
                    pa.array([x for x, *_ in got], pa.list_(pa.int32())),
                    pa.array([x for _, x, _ in got], pa.float64()),
                    pa.array([x + m for (*_, x), m in zip(got, batch.column(3).to_pylist())], pa.list_(pa.float64())),
                    batch.column(2)
                ],
                names=["id", "words", "weight", "dense", "label"],
            )

    got = rows.mapInArrow(run, "id string, words array<int>, weight double, dense array<double>, label int").toArrow()
    wide = len(STATISTICS) + len(meta)
    share = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    label = np.array(got["label"].to_pylist(), float)
    if len(set(label)) < 2:
        p = np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99)
        return Machine(
            buckets,
            float(np.log(p / (1 - p))),
            np.zeros(buckets + wide),
            np.zeros((buckets + wide, 1)),
            np.zeros(wide),
            np.ones(wide),
        )
    m = fit(
        [x or [] for x in got["words"].to_pylist()],
        got["weight"].to_pylist(),
        np.array(got["dense"].to_pylist()),
        label,
        buckets,
        **options
    )
    # from the sample's balance to that of all labels
    m.bias += float(np.log(share[1] / share[0]) - np.log(label.mean() / (1 - label.mean())))
    return m


def score(
    docs: DataFrame,
    machine: Machine,
    keep: list[str],
    text_col: str = "text",
    meta: tuple[Column, ...] = (),
    threshold: float = 0.7,
    score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """The columns `keep` of docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    A null or empty text has no words and all statistics 0, and is scored like any other. Repeated rows each come
    back; columns named like the new ones are replaced; an empty table stays empty. A null metadata value is 0.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(machine)
    keep = [c for c in keep if c not in (score_col, predicted_col)]
    text, more = fresh(keep, "_text", "_meta")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text), _numbers(meta).alias(more))
    schema = ", ".join(
        [
            *(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep),
            f"`{score_col}` double, `{predicted_col}` int"
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        m = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                got = [features(t, m.buckets) for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
                dense = np.array(
                    [x + e for (*_, x), e in zip(got, batch.column(len(keep) + 1).to_pylist())]
                ).reshape(len(got), -1)
                z = m.score(*m.assemble([x for x, *_ in got], [x for _, x, _ in got], dense), len(got))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in range(len(keep))),
                        pa.array(p),
                        pa.array((p >= threshold).astype(np.int32))
                    ],
                    names=[*keep, score_col, predicted_col],
                )

    return map_in_arrow(source, run, T.StructType.fromDDL(schema))
