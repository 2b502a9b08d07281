"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of a word given the (up to) three before it, the word's borders
included. N-grams are counted over every training text: each task counts its texts' words, then the n-grams of
the distinct ones; Spark sums them up. Continuation counts, discounts and back-off weights are DataFrame
aggregates. What goes to the executors are sorted arrays of 64-bit hashes, for each order, with the languages' log
probabilities beside them. They are bounded: beyond MOST values for an order the n-grams that occur least in all
languages together are not in them, and what they had falls to the shorter context, so that each of these models stays a
distribution over the characters of all languages and one unseen character.

Texts do not lose the n-grams beyond that bound. Where there are any, the whole model stays as tables (`Whole`), and texts
are scored by it: the log probabilities of the n-grams that occur most are broadcast, a text's other n-grams leave as
rows, meet the tables of all orders in joins and come back as sums by text.

A text goes to the language with the lowest cross-entropy per character; of equal ones to the first by name. Its score is
the share of that language in exp(-sharpness * cross-entropy), sharpness fitted to training texts that the
counts leave out; below `reject` it is not accepted.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylight.llm.common import alone, fresh, least_of_most, map_in_arrow, prepare, written

ORDER, MOST = 4, 1 << 22
COLUMNS = [f"c{i}" for i in range(ORDER)]
#: Values of the n-grams of texts, at most, that meet their texts by a broadcast, as they are in the most of them.
HOT = 200_000
BORDER = 2  # its code; a character has its code point and 3
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_counts(text: str) -> Counter:
    """How often each word occurs: lower-cased, split at white space."""
    return Counter(text.lower().split())


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each character and word end with the order - 1 codes before it (columns, oldest first), and the word's number.

    Before a word there are border codes.
    """
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64) + 3
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + order)[:-1]]) if len(words) else size
    codes = np.full(int((size + order).sum()), BORDER, np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    before = np.cumsum(size) - size
    codes[start[owner] + order - 1 + np.arange(len(flat)) - before[owner]] = flat
    owners = np.repeat(np.arange(len(words)), size + 1)
    first = np.cumsum(size + 1) - (size + 1)
    at = start[owners] + order - 1 + np.arange(len(owners)) - first[owners]
    return codes[at[:, None] + np.arange(1 - order, 1)], owners


def hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of codes (of two among a billion n-grams, 1 in 40 such tables has a pair that shares one)."""
    h = np.full(len(codes), 7, np.uint64)
    for column in codes.T:
        h = (h ^ column.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "c0", "c1", "c2", "c3", "n"]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, table in held.items():
            codes = np.frombuffer(b"".join(table), np.int64).reshape(-1, ORDER)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(codes), pa.string()),
                    *(pa.array(codes[:, i]) for i in range(ORDER)),
                    pa.array(np.fromiter(table.values(), np.int64))
                ],
                names=names,
            )

    held: dict[str, Counter] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(text.lower().split())
        for lang, seen in words.items():
            # equal words of a batch are counted first, then equal n-grams of its distinct words
            listed, counts = list(seen), np.fromiter(seen.values(), np.int64)
            for lo in range(0, len(listed), 50_000):
                codes, owner = grams(listed[lo : lo + 50_000])
                order = np.lexsort(codes.T[::-1])
                codes, weight = codes[order], counts[lo + owner[order]]
                first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
                raw, total = codes[first].tobytes(), np.add.reduceat(weight, first).tolist()
                table = held.setdefault(lang, Counter())
                for i, n in enumerate(total):
                    table[raw[32 * i : 32 * i + 32]] += n
        if sum(map(len, held.values())) > 400_000:
            yield from flush(held)
            held = {}
    yield from flush(held)


def _hash(codes: list[str]) -> F.Column:
    @F.pandas_udf("long")
    def hashed(c: pd.DataFrame) -> pd.Series:
        return pd.Series(hashes(c.to_numpy(np.int64)))

    return hashed(F.struct(*codes))


class Model:
    """Sorted hash arrays: for each order the hashes, then for each of the languages the log probability of the n-gram.

    backoff: the same for contexts: log of the weight that falls to the shorter context. floor: for each language the log
    probability of a character that it has not seen. Without languages every text is `und`.
    whole: the model with all n-grams, if these arrays leave some out; texts are scored by it then.
    """

    def __init__(self, langs: list[str], seen: dict, backoff: dict, floor: np.ndarray):
        self.langs, self.seen, self.backoff, self.floor, self.sharpness = langs, seen, backoff, floor, 8.0
        self.whole: Whole | None = None

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = table
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of each row's last code given those before it, for each language."""
        out = np.tile(self.floor, (len(codes), 1))
        for n in range(1, ORDER + 1):
            own = codes[:, ORDER - n :]
            if n > 1:
                at, there = self._find(self.backoff[n], hashes(own[:, :-1]))
                out[there] += self.backoff[n][1][at[there]]
            at, there = self._find(self.seen[n], hashes(own))
            values = self.seen[n][1][at[there]]
            out[there] = np.logaddexp(out[there], values)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word, for each language."""
        out = np.zeros((len(words), len(self.langs)))
        for lo in range(0, len(words), 20_000):
            codes, owner = grams(words[lo : lo + 20_000])
            order = np.lexsort(codes.T[::-1])
            first = np.concatenate(
                [[True], (codes[order][1:] != codes[order][:-1]).any(axis=1)]
            ) if len(codes) else np.zeros(0, bool)
            number = np.empty(len(codes), np.int64)
            number[order] = np.cumsum(first) - 1
            p = self.log_probability(codes[order][first])[number]
            np.add.at(out, lo + owner, p) if len(words) < 64 else self._sum(out, lo + owner, p)
        return out

    @staticmethod
    def _sum(out: np.ndarray, owner: np.ndarray, p: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] += np.add.reduceat(p, first, axis=0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (word ends count) for each language, and how many these are. No letter: 0 of them."""
        number, which, times, owner, size = _words(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if len(which):
            self._sum(total, owner, self.words(list(number))[which] * times[:, None])
        return -total / np.maximum(size, 1)[:, None], size


def _posterior(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


class Whole:
    """The model with all n-grams, as tables in the shared folder.

    grams: for each order the codes and p, for each language the n-gram's own probability (0: not seen). contexts: the same for
    all but the last code and the weight that falls to the shorter context (1: not seen). floor: for each language the
    probability of an unseen character. known: hashes of the n-grams that occur most, and their log probabilities.
    """

    def __init__(self, langs: list[str], grams: dict, contexts: dict, floor: np.ndarray):
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """`wanted`, distinct codes and other columns, with p: for each language the last code's probability given those before it.

        Each order looks at the distinct n-grams, so a key of these joins has at most as many rows as there are characters.
        """
        level = {ORDER: wanted}
        for n in range(ORDER - 1, 0, -1):
            level[n] = level[n + 1].select(*COLUMNS[ORDER - n :]).distinct()

        def each(value: float) -> F.Column:
            return F.array(*[F.lit(value)] * len(self.langs))

        p = None
        for n in range(1, ORDER + 1):
            own = COLUMNS[ORDER - n :]
            have = level[n].join(self.grams[n].withColumnRenamed("p", "_own"), own, "left")
            if n == 1:
                shorter = F.array(*map(F.lit, self.floor.tolist()))
            else:
                have = have.join(self.contexts[n].withColumnRenamed("p", "_weight"), own[:-1], "left")
                have = have.join(p.withColumnRenamed("p", "_shorter"), own[1:])
                shorter = F.zip_with(F.coalesce("_weight", each(1.0)), "_shorter", lambda w, x: w * x)
            total = F.zip_with(F.coalesce("_own", each(0.0)), shorter, lambda x, y: x + y)
            p = have.select(*level[n].columns, total.alias("p"))
        return p

    def entropies(self, source: DataFrame) -> DataFrame:
        """The columns of `source` but its last, a text, with e (nats per character for each language) and size (characters,
        word ends count; no letter: 0). Names of `source` must not clash with these, `row`, `sums`, `rest` and `text`.
        """
        keep = source.columns[:-1]
        kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
        more = "row long, size long, sums array<double>, rest array<struct<c0:long,c1:long,c2:long,c3:long,n:long>>"
        sent = source.sparkSession.sparkContext.broadcast(self.known)
        texts = written(source.mapInArrow(_split(sent, len(keep)), f"{kinds}, {more}" if keep else more), "texts")
        pairs = texts.select("row", F.explode("rest").alias("g")).select("row", "g.*")
        wanted = written(pairs.groupBy(*COLUMNS).agg(F.count("*").alias("texts")), "wanted")
        p = written(self.probabilities(wanted), "wanted")
        # an n-gram of many texts would be a hot key
        hot = least_of_most(p, "texts", HOT // len(self.langs), 10_000)
        met = pairs.join(F.broadcast(p.where(F.col("texts") >= hot)), COLUMNS).unionByName(
            pairs.join(p.where(F.col("texts") < hot), COLUMNS)
        )
        sums = met.groupBy("row").agg(
            F.array(*[F.sum(F.col("n") * F.log(F.col("p")[i])) for i in range(len(self.langs))]).alias("_more")
        )
        total = F.when(F.col("_more").isNull(), F.col("sums")).otherwise(
            F.zip_with("sums", "_more", lambda x, y: x + y)
        )
        e = F.transform(total, lambda x: -x / F.greatest(F.col("size"), F.lit(1)))
        return texts.drop("rest").join(sums, "row", "left").select(*keep, e.alias("e"), "size")


def _split(sent, at: int):
    """For each text the sums of its known n-grams' log probabilities, and its other n-grams with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alone()
        keys, values = sent.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                number, which, times, owner, size = _words(batch.column(at).to_pylist())
                words, sums = list(number), np.zeros((batch.num_rows, values.shape[1]))
                own, others, ends = np.zeros((len(words), values.shape[1])), [np.zeros((0, ORDER), np.int64)], [which[:0]]
                for first in range(0, len(words), 20_000):
                    codes, word = grams(words[first : first + 20_000])
                    place, there = Model._find(sent.value, hashes(codes))
                    p = np.zeros((len(codes), values.shape[1]))
                    p[there] = values[place[there]]
                    Model._sum(own, first + word, p)
                    others.append(codes[~there])
                    ends.append(first + word[~there])
                if len(which):
                    Model._sum(sums, owner, own[which] * times[:, None])
                # the other n-grams of each word stand together
                codes, word = np.concatenate(others), np.concatenate(ends)
                n = np.bincount(word, minlength=len(words))[which]
                begin = np.searchsorted(word, which)
                spot = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found = pd.DataFrame(codes[spot], columns=COLUMNS)
                found.insert(0, "text", np.repeat(owner, n))
                found["n"] = np.repeat(times, n)
                found = found.groupby(["text", *COLUMNS], as_index=False)["n"].sum()
                offsets = np.searchsorted(found["text"].to_numpy(), np.arange(batch.num_rows + 1))
                fields = [*COLUMNS, "n"]
                rest = pa.StructArray.from_arrays([pa.array(found[c].to_numpy(np.int64)) for c in fields], names=fields)
                new = [
                    pa.array(row + np.arange(batch.num_rows)),
                    pa.array(size),
                    pa.array(sums.tolist(), pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)
                ]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(at)), *new],
                    names=[*batch.schema.names[:at], "row", "size", "sums", "rest"],
                )

    return run


def _words(texts: list[str | None]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, numbered; for each text's distinct words the number, how often, and the text; each text's characters
    (word ends count). Texts without a letter have none.
    """
    number: dict[str, int] = {}
    which, times, owner = [], [], []
    size = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            for word, n in word_counts(text).items():
                which.append(number.setdefault(word, len(number)))
                times.append(n)
                owner.append(i)
                size[i] += n * (len(word) + 1)
    return number, np.array(which, np.int64), np.array(times, np.int64), np.array(owner, np.int64), size


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    calibration_rows: int = 2000,
    id_col: str = "doc_id",
    most_languages: int = 200,
    most: int = MOST,
) -> Model:
    """A model from every row with a text and a language but those that the sharpness is fitted to: these are the
    rows of least id hash, one in 20 and calibration_rows at most (rows of one id stay together).

    most: n-grams times languages of an order in the model's arrays. Where there are more, the rarest n-grams are not in these, and
    the model has a `whole` with all of them, by which texts are scored. Over most_languages languages are an error. With no row, or none with a language, the model knows no language. Repeated rows count each.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.xxhash64(F.col(id_col)).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("text is not null and lang is not null")
    ids = rows.select("id")
    held = min(calibration_rows, ids.count() // 20)
    limit = ids.orderBy("id").limit(held).agg(F.max("id")).first()[0] if held else None
    learnt = rows if limit is None else rows.where(F.col("id") > limit)
    sums = learnt.select("text", "lang").mapInArrow(_count, "lang string, c0 long, c1 long, c2 long, c3 long, n long")
    cols = COLUMNS
    top = written(sums.groupBy("lang", *cols).agg(F.sum("n").alias("n")), "grams")
    langs = [r.lang for r in top.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(langs) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not langs:
        return Model([], {}, {}, np.zeros(0))
    seen, backoff, have, every, cut = {}, {}, top, {}, False
    vocabulary = top.select("c3").distinct().count() + 1
    for n in range(ORDER, 0, -1):  # each lower order counts the distinct codes before its n-grams
        own = cols[ORDER - n :]
        if n < ORDER:
            have = written(have.groupBy("lang", *own).agg(F.count("*").alias("n")), "grams")
        d = have.groupBy("lang").agg(
            (F.count_if(F.col("n") == 1) + 0.5).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")
        )
        d = d.select("lang", (F.col("n1") / (F.col("n1") + 2 * F.col("n2") + 0.5)).alias("d"))
        counts, least = _bound(have, own, most // len(langs))
        frequent = counts.where(F.col("n") >= least).select(*own)
        cut = cut or (least > 1 and counts.where(F.col("n") < least).limit(1).count() > 0)
        totals = have.groupBy("lang", *own[:-1]).agg(F.sum("n").alias("all"))

        def own_share(rows: DataFrame) -> DataFrame:
            p = rows.join(F.broadcast(d), "lang")  # a row for each language
            return p.join(totals, ["lang", *own[:-1]]).withColumn("p", (F.col("n") - F.col("d")) / F.col("all"))

        every[n] = own_share(have)
        p = own_share(have.join(frequent, own, "left_semi"))
        seen[n] = _array(p.select("lang", _hash(own).alias("h"), "p"), langs)
        if n > 1:
            b = _left(p, own[:-1])
            backoff[n] = _array(b.select("lang", _hash(own[:-1]).alias("h"), "p"), langs, missing=0.0)
    model = Model(langs, seen, backoff, np.log(_floor(p, langs, vocabulary)))
    if cut:
        model.whole = Whole(
            langs,
            {n: written(_by_language(p, cols[ORDER - n :], langs, 0.0), "grams") for n, p in every.items()},
            {
                n: written(_by_language(_left(p, cols[ORDER - n : -1]), cols[ORDER - n : -1], langs, 1.0), "grams")
                for n, p in every.items()
                if n > 1
            },
            _floor(every[1], langs, vocabulary),
        )
        known = model.whole.probabilities(_frequent(top, cols, most // len(langs)))
        one = F.explode(F.arrays_zip(F.array(*map(F.lit, langs)).alias("lang"), F.col("p").alias("p"))).alias("x")
        model.whole.known = _array(known.select(_hash(cols).alias("h"), one).select("h", "x.lang", "x.p"), langs)
    if limit is not None:
        model.sharpness = _sharpness(model, rows.where(F.col("id") <= limit))
    return model


def _frequent(have: DataFrame, own: list[str], most: int) -> DataFrame:
    """The n-grams that occur most in all languages together: at most `most`, by the least number of occurrences that allows it."""
    counts, least = _bound(have, own, most)
    return counts.where(F.col("n") >= least).select(*own)


def _bound(have: DataFrame, own: list[str], most: int) -> tuple[DataFrame, int]:
    """How often each n-gram occurs in all languages together, and the least number that at most `most` of them reach."""
    counts = have.groupBy(*own).agg(F.sum("n").alias("n"))
    return counts, least_of_most(counts, "n", most, 100_000)


def _left(p: DataFrame, context: list[str]) -> DataFrame:
    """What of each context's probability falls to the shorter one."""
    return p.groupBy("lang", *context).agg(F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("p"))


def _floor(p: DataFrame, langs: list[str], vocabulary: int) -> np.ndarray:
    """The probability of an unseen character, for each language."""
    left = {r.lang: r.p for r in p.groupBy("lang").agg((1 - F.sum("p")).alias("p")).collect()}
    return np.array([max(left.get(x, 1.0), 1e-9) / vocabulary for x in langs])


def _by_language(df: DataFrame, keys: list[str], langs: list[str], missing: float) -> DataFrame:
    """A row for each key, with p as an array over the languages."""
    got = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("m"))
    every = F.transform(
        F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(missing))
    )
    return got.select(*keys, every.alias("p"))


def _array(df: DataFrame, langs: list[str], missing: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """As arrays on the driver; the number of rows is bounded by the pruning."""
    got = df.select("h", "lang", F.log("p").cast("float").alias("p")).toPandas()
    h = got["h"].to_numpy(np.int64)
    keys = np.unique(h)
    values = np.full((len(keys), len(langs)), missing, np.float32)
    values[np.searchsorted(keys, h), pd.Categorical(got["lang"], categories=langs).codes] = got["p"]
    return keys, values


def _sharpness(model: Model, rows: DataFrame) -> float:
    """The one under which the true languages of the rows are likeliest; entropies come from the executors."""
    if model.whole:
        return _likeliest(model, model.whole.entropies(rows.select("lang", "text")).where("size > 0").toPandas())
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, size = sent.value.entropies(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(e.tolist(), pa.list_(pa.float64())), batch.column(1), pa.array(size)],
                names=["e", "lang", "size"],
            )

    got = rows.select("text", "lang").mapInArrow(
        run, "e array<double>, lang string, size long"
    ).where("size > 0").toPandas()
    return _likeliest(model, got)


def _likeliest(model: Model, got: pd.DataFrame) -> float:
    if not len(got):
        return model.sharpness
    e, true = np.array(got["e"].tolist()), pd.Categorical(got["lang"], categories=model.langs).codes
    best = {}
    for s in np.geomspace(1, 64, 25):
        z = -s * (e - e.min(axis=1, keepdims=True))
        best[s] = (z[np.arange(len(z)), true] - np.log(np.exp(z).sum(axis=1))).sum()
    return float(max(best, key=best.get))


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The columns `keep` of docs, with lang_pred, score (0 to 1), accepted (score >= reject) and cross_entropy (nats per character).

    A null text and one without a letter get `und`, score 0, not accepted, and so does every text if the model knows no
    language. White space and case do not count. Of languages with equal cross-entropy the first by name is taken.
    Repeated rows each come back; columns named like the new ones are replaced; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    keep = [c for c in keep if c not in ("lang_pred", "score", "accepted", "cross_entropy")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(fresh(keep, "_text")[0]))
    kinds = ", ".join(
        [
            *(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep),
            "lang_pred string, score double, accepted boolean, cross_entropy double"
        ]
    )

    known, sharpness, scored = model.langs, model.sharpness, model.whole is not None
    if scored:
        inner = [f"k{i}" for i in range(len(keep))]
        source = model.whole.entropies(source.toDF(*inner, "text")).toDF(*keep, *fresh(keep, "_e", "_size"))
    sent = None if scored else spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        langs = np.array([*known, "und"], object)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                if scored:
                    e, size = np.array(batch.column(len(keep)).to_pylist()), batch.column(len(keep) + 1).to_numpy()
                elif known:
                    e, size = sent.value.entropies(batch.column(len(keep)).to_pylist())
                else:
                    e, size = np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, np.int64)
                best = np.where(size > 0, e.argmin(axis=1), len(langs) - 1)
                score = np.where(size > 0, _posterior(e, sharpness).max(axis=1), 0.0)
                new = [
                    pa.array(langs[best], pa.string()),
                    pa.array(score),
                    pa.array((size > 0) & (score >= reject)),
                    pa.array(np.where(size > 0, e.min(axis=1), np.nan))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), *new],
                    names=[*keep, "lang_pred", "score", "accepted", "cross_entropy"],
                )

    return map_in_arrow(source, run, T.StructType.fromDDL(kinds))
