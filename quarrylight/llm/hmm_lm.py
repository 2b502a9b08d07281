"""A hidden Markov language model over words.

Each token has a latent state. A state emits symbols: the most frequent words and the end of a text are one each, all
other words share classes by their last two bytes, and a class gives its words their share of its training tokens
(absolute discounting; what it takes off is the class's unseen word's). So the model is a distribution over the
training vocabulary with an unseen word for each class, its state tables are of bounded size, and the vocabulary, which
grows with the corpus, stays in Spark.

1. Each task counts the words of its training texts; Spark sums the counts up.
2. One scan turns each text into symbols. The counts of the `cached` most frequent words go along as a broadcast and
   give most tokens' scores there; the other words leave as (text, word, times), meet their counts in a join by word and
   come back as sums by text. No word of that join is frequent, so none is a hot key.
3. Baum-Welch: in each round every partition runs scaled forward and backward recursions over its whole training texts
   and gives expected counts, which Spark sums up. The start depends on the corpus counts and a fixed seed.
4. The scaled forward recursion gives each whole text's likelihood, exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.llm.common import least_of_most, prepare, written

END = b"\n"  # no word has white space
DISCOUNT = 0.75
DESCRIBED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, symbols binary, "
    "rare array<struct<word:binary,times:int>>"
)


@dataclass(frozen=True)
class Shape:
    """frequent: words that are symbols. cached: words, at most, whose counts are broadcast. cells: tokens of texts that step together."""

    states: int = 8
    frequent: int = 16384
    classes: int = 512
    rounds: int = 5
    cached: int = 131_072
    cells: int = 1 << 18

    @property
    def symbols(self) -> int:
        return self.frequent + self.classes


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def _count(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """How often each word occurs; a task's table is given away when it is large."""

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for lo in range(0, len(words), 50_000):
            some = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "c"]
            )

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            seen.update(tokens(text))
            if len(seen) > most:
                yield from flush()
                seen = Counter()
    yield from flush()


@dataclass
class Words:
    """What goes to the executors: the most frequent words with what each gives to a text's scores."""

    number: dict[bytes, int]  # by count; those below shape.frequent are symbols
    symbol: np.ndarray
    base: np.ndarray
    within: np.ndarray
    count: np.ndarray


def _describe(shape: Shape, sent):
    """For each text its symbols, the scores of its cached words, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Words = sent.value
        get, suffix = w.number.get, {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                cut = [tokens(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                size = np.fromiter(map(len, cut), np.int64, len(cut))
                first = np.cumsum(size) - size
                flat = [x for one in cut for x in one]
                at = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                symbol = w.symbol[at]
                odd = np.flatnonzero(at < 0)
                for i in odd.tolist():
                    tail = flat[i][-2:]
                    k = suffix.get(tail)
                    if k is None:
                        k = suffix[tail] = shape.frequent + class_of(tail, shape.classes)
                    symbol[i] = k
                rare: list[list[dict]] = []
                edges = np.searchsorted(odd, np.append(first, len(flat))).tolist()
                for a, b in zip(edges, edges[1:]):
                    rare.append(
                        [{"word": x, "times": n} for x, n in Counter(flat[i] for i in odd[a:b].tolist()).items()]
                    )
                raw = symbol.astype("<u2")
                columns = [
                    batch.column("doc_id"),
                    pa.array(~batch.column("train").to_numpy(zero_copy_only=False).astype(bool)),
                    pa.array(size),
                    *(pa.array(np.add.reduceat(table[at], first).astype(kind)) for table, kind in ((w.count > 0, np.int64), (w.base, float), (w.within, float))),
                    pa.array([raw[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist())], pa.binary()),
                    pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols", "rare"]
                )

    return run


@dataclass
class Tables:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # symbols by states

    def normalised(self, ridge: float = 0.05) -> "Tables":
        n = self.emit.sum(axis=1, keepdims=True)
        prior = (n + 0.5) / (n + 0.5).sum()  # a state falls back to the symbol's share of all tokens
        emit = self.emit + ridge * prior * max(self.emit.sum(axis=0).mean(), 1.0)
        return Tables(
            (self.start + 1) / (self.start + 1).sum(),
            (self.move + 1) / (self.move + 1).sum(axis=1, keepdims=True),
            emit / emit.sum(axis=0),
        )


def _zero(t: Tables) -> Tables:
    return Tables(np.zeros_like(t.start), np.zeros_like(t.move), np.zeros_like(t.emit))


def _together(texts: list[np.ndarray], cells: int) -> Iterator[list[np.ndarray]]:
    """Texts of about one length, longest first, so many that they have at most `cells` tokens when filled up; one at least."""
    order = sorted(texts, key=lambda x: -len(x))
    at = 0
    while at < len(order):
        n = max(1, cells // max(1, len(order[at])))
        yield order[at : at + n]
        at += n


def expected(t: Tables, texts: list[np.ndarray], cells: int = 1 << 18) -> tuple[Tables, float]:
    """Baum-Welch counts of whole texts and their log likelihood (nats).

    Texts of about one length step together. A text longer than `cells` is taken in stretches: the state before each is kept
    on the way forward, and on the way back the stretch's states are computed again from it and joined to what follows.
    """
    out, ll = _zero(t), 0.0
    padded = np.append(t.emit, np.ones((1, len(t.start))), axis=0)  # the last symbol fills up and changes nothing
    blank = len(t.emit)
    for some in _together([x for x in texts if len(x)], cells):
        sym = np.full((len(some[0]), len(some)), blank, np.int64)
        for i, x in enumerate(some):
            sym[: len(x), i] = x
        step = max(1, cells // len(some))
        cuts = list(range(0, len(sym), step))
        before: list[np.ndarray | None] = [None]
        for lo in cuts[:-1]:  # only for a text longer than `cells`
            alpha, _ = _ahead(t, padded[sym[lo : lo + step]], before[-1])
            before.append(alpha[-1])
        beta = np.ones((len(some), len(t.start)))
        for lo, prior in zip(reversed(cuts), reversed(before)):
            part = sym[lo : lo + step]
            obs = padded[part]
            alpha, scale = _ahead(t, obs, prior)
            ll += float(np.log(scale).sum())
            live = part != blank
            for i in range(len(part) - 1, -1, -1):
                gamma = alpha[i] * beta
                weighed = obs[i] * beta / scale[i][:, None]
                alpha[i], back = gamma, alpha[i - 1] if i else prior  # gamma takes alpha's place once it is used
                if back is None:
                    out.start += gamma.sum(axis=0)
                else:
                    real = live[i]
                    out.move += t.move * (back[real].T @ weighed[real])
                    beta = weighed @ t.move.T
            flat = part.ravel()
            for s in range(len(t.start)):
                out.emit[:, s] += np.bincount(flat, alpha[:, :, s].ravel(), blank + 1)[:blank]
    return out, ll


def _ahead(t: Tables, obs: np.ndarray, prior: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward states of each step (steps, texts, states) and the scales, from the states before the first step."""
    alpha, scale = np.empty_like(obs), np.empty(obs.shape[:2])
    for i in range(len(obs)):
        a = (t.start if prior is None else prior @ t.move) * obs[i]
        scale[i] = a.sum(axis=1)
        prior = alpha[i] = a / scale[i][:, None]
    return alpha, scale


def forward(t: Tables, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each text's symbols' probability by the scaled forward recursion over the whole text; texts step together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    flat, first = np.concatenate([texts[i] for i in order]), np.cumsum(size) - size
    alpha, ll = np.tile(t.start, (len(order), 1)), np.zeros(len(order))
    live = len(order)
    for i in range(int(size[0])):
        while live and size[live - 1] <= i:
            live -= 1
        a = (alpha[:live] @ t.move if i else alpha[:live]) * t.emit[flat[first[:live] + i]]
        total = a.sum(axis=1)
        ll[:live] += np.log10(total)
        alpha[:live] = a / total[:, None]
    out[order] = ll
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The symbols of texts with about `most` tokens together, so that there are texts of about one length."""
    texts, size = [], 0
    for batch in batches:
        texts += [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
        size += sum(map(len, texts[-batch.num_rows :])) if batch.num_rows else 0
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _round(sent, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        total = _zero(t)
        for texts in _gathered(batches, 8 * cells):
            got, _ = expected(t, texts, cells)
            total = Tables(total.start + got.start, total.move + got.move, total.emit + got.emit)
        rows = np.concatenate([total.emit, total.move, total.start[None, :]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["i", "v"]
        )

    return run


def _baum_welch(described: DataFrame, t: Tables, shape: Shape) -> Tables:
    """One round over all training texts: each partition's counts (symbols by states), summed up by Spark."""
    sent = described.sparkSession.sparkContext.broadcast(t)
    parts = described.where("not held_out").select("symbols").mapInArrow(
        _round(sent, shape.cells), "i long, v array<double>"
    )
    sums = parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(s))).alias(f"s{s}") for s in range(shape.states)])
    rows = np.zeros((shape.symbols + shape.states + 1, shape.states))
    for r in sums.collect():
        rows[r.i] = r[1:]
    return Tables(rows[-1], rows[shape.symbols : -1], rows[: shape.symbols]).normalised()


def language_model(
    docs: DataFrame, train: Column, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores every whole text; learns from the rows for which `train` holds.

    doc_id, held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens, base_score
    (log10, unigrams with one added), score (log10 of the model's probability of the text). A null text is empty: the end
    alone. A null `train` counts as false. Repeated rows are learnt from and scored each. With nothing to learn from every
    word is unseen. An empty table gives no row. Further columns are not read, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.col(text_col).alias("text"),
    )
    sums = source.where("train").select("text").mapInArrow(_count, "word binary, c long")
    counts = written(sums.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = least_of_most(counts, "c", shape.cached, 1_000_000)
    # at most `cached`
    top = sorted(
        ((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0])
    )
    if END not in dict(top[: shape.frequent]):  # the end is a symbol and known, however few texts there are
        end = counts.where(F.col("word") == END).first()
        top = [x for x in top if x[0] != END]
        top.insert(shape.frequent - 1, (END, end.c if end else 0))

    last = F.pmod(
        F.crc32(F.when(F.octet_length("word") > 1, F.substring("word", -2, 2)).otherwise(F.col("word"))),
        F.lit(shape.classes),
    ).cast("int")
    class_n, class_v = np.zeros(shape.classes), np.zeros(shape.classes)
    for r in counts.groupBy(last.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[r.k], class_v[r.k] = r.n, r.v
    for w, c in top[: shape.frequent]:  # these have symbols of their own
        k = class_of(w, shape.classes)
        class_n[k], class_v[k] = class_n[k] - c, class_v[k] - (c > 0)

    # what a word gives to a text's scores; the last entry stands for words that are not cached, which add theirs later
    kind = np.array([class_of(w, shape.classes) for w, _ in top])
    count = np.array([c for _, c in top], float)
    own = np.arange(len(top)) < shape.frequent
    within = np.where(own, 0.0, np.log10(np.maximum(count - DISCOUNT, 1e-9) / np.maximum(class_n[kind], 1.0)))
    words = Words(
        {w: i for i, (w, _) in enumerate(top)},
        np.append(np.where(own, np.arange(len(top)), shape.frequent + kind), 0),
        np.append(np.log10((count + 1) / (total.n + total.v + 1)), 0.0),
        np.append(within, 0.0),
        np.append(count, 0.0),
    )
    sent = spark.sparkContext.broadcast(words)  # at most `cached` words
    described = source.mapInArrow(_describe(shape, sent), DESCRIBED).withColumn("row", F.monotonically_increasing_id())
    described = written(described, "described")

    unseen = np.log10(np.where(class_n > 0, DISCOUNT * class_v / np.maximum(class_n, 1.0), 1.0))
    of_class = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("k"))
    rare = described.select("row", F.explode("rare").alias("r")).select(
        "row", F.col("r.word").alias("word"), F.col("r.times").alias("times")
    )
    seen = counts.withColumn("k", last)
    seen = seen.select(
        "word", "c", (F.log10(F.col("c") - DISCOUNT) - F.log10(of_class(np.maximum(class_n, 1.0)))).alias("seen")
    )
    met = rare.join(seen, "word", "left").withColumn("k", last)
    met = met.select(
        "row",
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total.n + total.v + 1)))).alias("base"),
        (F.col("times") * F.coalesce("seen", of_class(unseen))).alias("within"),
    )
    more = met.groupBy("row").agg(
        F.sum("known").alias("_known"), F.sum("base").alias("_base"), F.sum("within").alias("_within")
    )

    unigram = np.zeros(shape.symbols)
    unigram[: min(len(top), shape.frequent)] = count[: shape.frequent]
    unigram[shape.frequent :] = class_n
    rng = np.random.default_rng(7)
    t = Tables(
        np.ones(shape.states),
        np.eye(shape.states) * 8 + 1,
        (unigram[:, None] + 0.5) * rng.gamma(2.0, 0.5, (shape.symbols, shape.states)),
    ).normalised()
    for _ in range(shape.rounds):
        t = _baum_welch(described, t, shape)
    model = spark.sparkContext.broadcast(t)
    slim = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within"]

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                ll = forward(model.value, [np.frombuffer(x, "<u2") for x in batch.column("symbols").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in slim), pa.array(ll)], names=[*slim, "ll"])

    scored = described.select(*slim, "symbols").mapInArrow(
        likelihood, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, ll double"
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "_known").cast("long").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), (plus("within", "_within") + F.col("ll")).alias("score"),
    )
