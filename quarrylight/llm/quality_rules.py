"""Quality rules in DataFrame operations alone: base counts of a text, and how much likelier its hashed n-grams are
under a trusted target than under the raw corpus.

Words and neighbouring pairs are hashed to `buckets`. The target's and the raw corpus's multinomials over these
come from one aggregation of all documents (partial counts of at most `buckets` rows leave a task). A text's score is its
sum of log ratios by its number of n-grams; the weights are a broadcast table with one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.llm.common import fresh, prepare, written

SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Ids of the trusted side up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def hashes(w: Column) -> Column:
    """XXH64 of each word. Windows and pairs are hashed from these, so that a word's letters are read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(h: Column, n: int) -> Column:
    """A 64-bit hash of each n successive words, from their hashes."""
    count = F.size(h) - (n - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def placed_repeats(hashes: Column) -> Column:
    """Hash and place of each window, equal hashes side by side; empty where no window occurs twice."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), placed
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_words(placed: Column, n: int) -> Column:
    """Words in windows found twice or more: how much the windows with an equal neighbour cover. placed: a column of its own, as each element looks into it."""
    again = F.filter(placed, lambda x, i: (x.h == F.get(placed, i - 1).h) | (x.h == F.get(placed, i + 1).h))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-n).alias("i"))
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x.i)),
        start,
        lambda a, i: F.struct((a.n + F.least(F.lit(n), i - a.i)).cast("bigint").alias("n"), i.alias("i")),
        lambda a: a.n,
    )


def base_counts(docs: DataFrame, text_col: str = "text", window: int = 8, hashes_col: str = "_hashes") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (replaced if there) and hashes_col, the words' hashes.

    A null text has none of these. Repeated rows each come back; an empty table stays empty; other columns stay as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, ls, win, placed = fresh([*docs.columns, hashes_col], "_words", "_lines", "_windows", "_placed")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    first = docs.withColumns(
        {
            w: words(F.col(text_col)),
            ls: lines,
            "n_symbols": F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("long"),
        }
    )
    counts = {
        hashes_col: hashes(F.col(w)),
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
    }
    third = first.withColumns(counts).drop(w, ls).withColumn(win, windows(F.col(hashes_col), window))
    fourth = third.withColumn(placed, placed_repeats(F.col(win))).drop(win)
    return fourth.withColumn("n_repeat_words", repeated_words(F.col(placed), window)).drop(placed)


def pairs(h: Column) -> Column:
    """Each word's hash with the next word's; null behind the last."""
    return F.arrays_zip(h.alias("one"), F.slice(h, 2, F.greatest(F.size(h), F.lit(1))).alias("two"))


def buckets_of(one: Column, two: Column, buckets: int) -> tuple[Column, Column]:
    """The buckets of a word and of the pair that it begins; the latter is null for a last word."""
    return F.pmod(one, F.lit(buckets)).cast("int"), F.when(
        two.isNotNull(), F.pmod(F.xxhash64(one, two), F.lit(buckets)).cast("int")
    )


def log_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = 1 << 16,
    smoothing: float = 10.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(bucket, weight): log of the trusted side's probability by the raw corpus's, for every bucket.

    trusted: the ids of the trusted documents, nulls and repeats left out. Raw: all documents, repeated rows each, null texts
    as empty. Empty tables give weight 0 for every bucket. Further columns are not read, whatever their names. smoothing: added to the trusted count of each
    bucket; the raw side gets as much more as the raw corpus is larger, so that what either side has hardly seen weighs little.
    """
    spark = prepare(docs.sparkSession)
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("_doc"), words(F.col(text_col)).alias("w")).select("_doc", hashes(F.col("w")).alias("h")).join(
        ids.withColumn("_in", F.lit(1)), F.col("_doc") == F.col("_id"), "left"
    )
    each = rows.select(F.explode(pairs(F.col("h"))).alias("p"), F.coalesce("_in", F.lit(0)).alias("t"))
    each = each.select(
        "t", F.explode(F.array(*buckets_of(F.col("p.one"), F.col("p.two"), buckets))).alias("bucket")
    ).where("bucket is not null")
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = written(counts, "ngrams")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = max(total["target"] or 0, 1) / max(total["raw"] or 0, 1)

    def p(count: str, n: int, more: float) -> Column:
        return (F.coalesce(F.col(count), F.lit(0)) + more) / (n + more * buckets)

    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select(
        "bucket",
        F.log(
            p("target", total["target"] or 0, smoothing) / p("raw", total["raw"] or 0, smoothing / share)
        ).alias("weight"),
    )


def judge(
    docs: DataFrame,
    weights: DataFrame,
    keep: list[str],
    threshold: float = -0.15,
    buckets: int = 1 << 16,
    min_words: int = 20,
    repeat_percent: int = 30,
    text_col: str = "text",
) -> DataFrame:
    """The columns `keep` of docs with the base counts, llr (by n-gram), base_failed and kept.

    base_failed: fewer than min_words words, or over repeat_percent of 100 of these in 8-word windows found twice or more.
    kept: not failed, and llr >= threshold. A text without words has llr 0 and fails. Columns named like
    these are replaced; repeated rows each come back; null texts count as empty.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in keep if c not in (*counts, "llr", "base_failed", "kept")]
    # the kept columns travel in one, so that their names meet no other
    counted = base_counts(
        docs.select(
            F.struct(F.lit(0).alias(fresh(keep, "none")[0]), *[F.col(f"`{c}`") for c in keep]).alias("own"),
            F.col(text_col).alias("text"),
        )
    )
    # a row's n-grams stay together in its task, so the partial sums that leave it are one row for each text
    spread = counted.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "own", *counts, F.explode_outer(pairs(F.col("_hashes"))).alias("p")
    )
    one, two = buckets_of(F.col("p.one"), F.col("p.two"), buckets)
    spread = spread.select("row", "own", *counts, one.alias("one"), two.alias("two"))
    for name in ("one", "two"):  # `buckets` rows are broadcast
        spread = spread.join(
            F.broadcast(weights.select(F.col("bucket").alias(name), F.col("weight").alias(f"w_{name}"))), name, "left"
        )
    total = F.coalesce(F.sum("w_one"), F.lit(0.0)) + F.coalesce(F.sum("w_two"), F.lit(0.0))
    grams = F.count("w_one") + F.count("w_two")
    summed = spread.groupBy("row", "own").agg(
        *[F.max(c).alias(c) for c in counts], F.when(grams > 0, total / grams).otherwise(F.lit(0.0)).alias("llr")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = summed.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
    return judged.select(*[F.col("own").getField(c).alias(c) for c in keep], *counts, "llr", "base_failed", "kept")
