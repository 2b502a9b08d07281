"""License scans by diagonal voting.

Every k successive words of every text are hashed and joined to the places of the same k words in license templates. The
words themselves are then compared, so a vote never rests on a hash. Votes of one text and one template with equal difference of
place (a diagonal) are summed; neighbouring diagonals, which words put in or left out set apart, are merged to a span. A
span counts if the template's words that its votes cover reach a share of the template. Where spans of several templates overlap,
those with the most covered words stay.

Texts are dealt to rows of CHUNK words before their hashes are listed, so a row stays small however long its text is. Texts
pass no shuffle: only votes do, by a key of 48 letters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylight.llm.common import fresh, prepare
from quarrylight.llm.license_texts import PHRASES, TEMPLATES
from quarrylight.llm.quality_rules import hashes, windows

CHUNK = 256
#: Places in templates up to which they are broadcast; more are joined by a shuffle.
BROADCAST_PLACES = 500_000
SPAN = "array<struct<start:bigint,words:bigint,label:string,coverage:double>>"
PLACE = "array<struct<at:bigint,label:string>>"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once, however often each element of a lambda looks into it."""
    return F.get(F.transform(F.array(x), use), 0)


def words(text: Column) -> Column:
    """Words of digits, ASCII letters and all other characters beyond ASCII. Upper case becomes lower case; no letter beyond ASCII becomes
    one of ASCII (the Kelvin sign alone would), so words of ASCII are equal exactly where only A-Z are made lower case."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))
    return F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def places(w: Column, phrases: Mapping[str, str]) -> Column:
    """(at, label) of every place where a phrase's words stand, by place. phrases: words to label."""

    def at(all_words: Column) -> Column:
        def here(x: Column, i: Column) -> Column:
            found = F.lit(None).cast("struct<at:bigint,label:string>")
            for phrase, label in phrases.items():
                first, *more = phrase.split(" ")
                same = x == first
                for k, word in enumerate(more, 1):
                    same = same & (F.coalesce(F.get(all_words, i + k), F.lit("")) == word)
                found = F.when(same, F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(found)
            return found

        return F.filter(F.transform(all_words, here), lambda p: p.isNotNull())

    return bound(w, at)


def template_places(spark, templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, size, place, gram, hash): a row for every k successive words of every template of k words or more."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    cut = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", words(F.col("text")).alias("w"))
    cut = cut.where(F.size("w") >= k).select("template", "label", F.size("w").alias("size"), "w", F.posexplode(bound(hashes(F.col("w")), lambda h: windows(h, k))))
    return cut.select("template", "label", "size", F.col("pos").alias("place"), F.slice("w", F.col("pos") + 1, k).alias("gram"), F.col("col").alias("hash"))


def votes(texts: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """(key, template, label, size, at, place) of every place in a text (key, text) whose k words are those of a template's place."""

    def chunks(w: Column) -> Column:
        begin = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)), F.lit(CHUNK))
        return F.transform(begin, lambda c: F.struct(c.alias("first"), F.slice(w, c + 1, CHUNK + k - 1).alias("w")))

    rows = texts.select("key", F.explode(bound(words(F.col("text")), chunks)).alias("c")).select("key", "c.first", "c.w")
    rows = rows.select("key", "first", "w", F.posexplode(bound(hashes(F.col("w")), lambda h: windows(h, k))).alias("i", "hash"))
    same = F.slice("w", F.col("i") + 1, k) == F.col("gram")
    return rows.join(grams, "hash").where(same).select(
        "key", "template", "label", "size", (F.col("first") + F.col("i")).alias("at"), "place"
    )


def spans(voted: DataFrame, k: int, drift: int, least: float) -> DataFrame:
    """(key, spans, score) of the texts with a span: its places and share of the template, and the greatest share."""
    diagonals = voted.groupBy("key", "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places")  # at most `size`
    )
    by_diagonal = Window.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift, F.lit(True))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by_diagonal)).groupBy(
        "key", "template", "label", "size", "run"
    ).agg(
        F.min("first").alias("first"),
        (F.max("last") + k).alias("end"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("p"))
    covered = F.aggregate(
        "places", none, lambda a, p: F.struct((a.n + F.least(F.lit(k), p - a.p)).alias("n"), p.alias("p")), lambda a: a.n
    )
    verified = merged.select("key", "label", "first", "end", covered.alias("covered"), (covered / F.col("size")).alias("share")).where(
        F.col("share") >= least
    )
    by_place = Window.partitionBy("key").orderBy("first", "end", "label")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = verified.withColumn("new", F.coalesce(F.col("first") >= reached, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(by_place)
    )
    best = island.withColumn("most", F.max("covered").over(Window.partitionBy("key", "island"))).where("covered = most")
    span = F.struct(
        F.col("first").cast("long").alias("start"),
        (F.col("end") - F.col("first")).cast("long").alias("words"),
        "label",
        F.col("share").alias("coverage"),
    )
    return best.groupBy("key").agg(F.array_sort(F.collect_set(span)).cast(SPAN).alias("spans"), F.max("share").alias("score"))


def scan_licenses(
    docs: DataFrame,
    keep: list[str] | None = None,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    k: int = 4,
    drift: int = 3,
    least: float = 0.7,
    text_col: str = "text",
    out_col: str = "license",
) -> DataFrame:
    """The rows of docs with their columns `keep` (None: all) and a struct out_col: n_words; places (at, label) of the phrases; spans
    (start, words, label, coverage) of the templates; labels of both, distinct and sorted; score: 1 with a place, else the greatest
    coverage, 0 without a span.

    templates: (label, text); those of fewer than k words have no votes. drift: by how many words neighbouring diagonals may
    differ; least: the share of a template's words that a span covers. A null text has no words. Repeated rows each come back;
    an empty table gives no row; a column named like out_col is replaced.
    """
    spark = prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    own = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # tells texts apart; what else is in a row spreads the copies of a text
    key = F.concat(F.md5(text), F.hex(F.xxhash64(F.lit(0), *[c.cast("string") for c in own])))
    grams = template_places(spark, templates, k)
    grams = F.broadcast(grams) if sum(len(t.split()) for _, t in templates) <= BROADCAST_PLACES else grams
    found = spans(votes(docs.select(key.alias("key"), text.alias("text")), grams, k), k, drift, least)
    w = words(text)
    base = docs.select(
        key.alias("key"),
        F.struct(F.lit(0).alias(fresh(keep, "none")[0]), *own).alias("own"),  # their names meet no other
        bound(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), places(x, phrases).alias("p"))).alias("b"),
    )
    joined = base.join(found, "key", "left")
    at = F.coalesce("b.p", F.array().cast(PLACE))
    span = F.coalesce("spans", F.array().cast(SPAN))
    labels = F.array_sort(F.array_union(F.transform(at, lambda p: p.label), F.transform(span, lambda s: s.label)))
    score = F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    return joined.select(
        *[F.col("own").getField(c).alias(c) for c in keep],
        F.struct(
            F.col("b.n").alias("n_words"), at.alias("places"), span.alias("spans"), labels.alias("labels"), score.alias("score")
        ).alias(out_col),
    )
