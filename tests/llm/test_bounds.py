"""Ranges of odd keys, exact bounds on what is broadcast, and columns of any name."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import common, hmm_lm, langid
from quarrylight.llm.decontaminate import mark, remove_contaminated
from quarrylight.llm.hmm_lm import Shape, language_model
from quarrylight.llm.line_dedup import remove_boilerplate
from quarrylight.llm.near_copies import keep_one
from quarrylight.llm.packing import Limits, pack
from quarrylight.llm.quality_fm import score, train
from quarrylight.llm.token_blocks import read_tokens, write_tokens
from quarrylight.llm.warc import read_warc, write_warc

LARGE = [2**62 + 3 * i + 1 for i in range(400)] + [2**63 - 1, -(2**63)]


def large_ids(spark):
    ids = LARGE + [None] * 5
    random.Random(1).shuffle(ids)
    return spark.createDataFrame([(x, f"text {x}") for x in ids], "id long, text string").repartition(7)


def test_token_files_of_large_and_null_ids(spark):
    """Nulls beside ids over 2**53: every document starts where the ones before it end, in order of ids."""
    folder = common.shared_path(spark, "tokens")
    docs = large_ids(spark).withColumnRenamed("id", "doc_id")
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, shard_bytes=400, least_bytes=100)
    rows = read_tokens(spark, folder).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None] * 5 + sorted(LARGE)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_archives_of_large_and_null_ids(spark):
    """The key ranges of files do not overlap."""
    folder = common.shared_path(spark, "warc")
    pages = large_ids(spark).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"))
    files = write_warc(pages, folder, shard_bytes=9000, roll_bytes=1 << 30, revisit_bytes=0, least_bytes=100).collect()
    got = read_warc(spark, folder)
    assert got.count() == len(LARGE) + 5 and len(files) > 5
    spans = sorted((r.first_key, r.last_key) for r in files if r.first_key is not None)
    assert all(x[0] <= x[1] for x in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("top", [3, 50, 10**6])
def test_least_of_most(spark, top):
    rng = np.random.default_rng(2)
    for counts in ([], [7], [5] * 9, rng.integers(1, 40, 200).tolist(), [10**12 + int(x) for x in rng.integers(0, 10**9, 50)] + [1, 2, 2**62]):
        df = spark.createDataFrame([(int(c),) for c in counts], "c long")
        for most in (0, 1, 3, 10, 1000):
            least = common.least_of_most(df, "c", most, top)
            reach = sum(c >= least for c in counts)
            assert reach <= most
            below = [c for c in counts if c < least]
            assert not below or reach + below.count(max(below)) > most


def test_model_with_more_frequent_words_than_it_caches(spark, monkeypatch):
    """Scores do not depend on how many words are cached beyond those with symbols, nor on the first bins' end."""
    real = common.least_of_most
    monkeypatch.setattr(hmm_lm, "least_of_most", lambda d, c, most, top: real(d, c, most, 20))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(40))) for i in range(60)]
    docs, out = spark.createDataFrame(rows, "doc_id long, text string"), []
    for cached in (3, 1000):
        got = language_model(docs, F.lit(True), Shape(frequent=2, cached=cached, rounds=2)).orderBy("doc_id").collect()
        assert all(r.n_known == r.n_tokens == 41 for r in got)
        out.append([(r.base_score, r.score) for r in got])
    assert np.allclose(*out, atol=1e-6)


def test_frequent_ngrams_are_bounded(spark):
    have = spark.createDataFrame([(i, 200_000 + i) for i in range(10)], "c0 long, n long")
    assert sorted(r.c0 for r in langid._frequent(have, ["c0"], 3).collect()) == [7, 8, 9]


def test_languages_do_not_depend_on_the_bound(spark, monkeypatch):
    """n-grams beyond what is broadcast count all the same: entropies equal those of the model that holds all of them."""
    rng = random.Random(8)
    text = {"en": "the cat sat on mat and dog ran", "de": "die katze und der hund auf dem dach", "fr": "le chat est sur la table"}
    rows = [(i, " ".join(rng.choices(w.split(), k=12)), k) for i in range(40) for k, w in text.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = [(900, None), (901, "12 !"), (902, ""), (903, "zebra Ωmega the"), (903, "zebra Ωmega the"), (None, "der die " * 3000)]
    asked = spark.createDataFrame(odd, "`a.id` long, text string").unionByName(docs.toDF("a.id", "text", "lang").drop("lang"))
    models, got = [langid.train(docs), langid.train(docs, most=30)], []
    assert models[0].whole is None and len(models[1].whole.known[0]) <= 10
    for model, hot in zip([*models, models[1]], (None, 9, 200_000)):
        monkeypatch.setattr(langid, "HOT", hot)
        rows = langid.identify(asked, model, keep=["a.id", "text"]).collect()
        got.append(sorted((r["a.id"] or -1, r.text or "", r.lang_pred, r.accepted, r.score, r.cross_entropy) for r in rows))
    for few in got[1:]:
        assert [r[:4] for r in few] == [r[:4] for r in got[0]] and len(few) == 126
        assert np.allclose([r[4:] for r in few], [r[4:] for r in got[0]], rtol=1e-4, equal_nan=True)


def test_names_with_dots_and_quotes(spark):
    """Columns of any name pass the operators and all stages of the pipeline."""
    rows = [(i, f"line of words number {i} here\nshared line of words in all", "en", f"s{i % 9}", 40) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"we.ird": F.lit("x"), "a b": F.lit(1), "c0": F.lit(2), "TEXT_": F.lit(3)})
    items = spark.createDataFrame([("q", "number 3 here")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def same(df, n):
        got = df.collect()
        assert df.columns[: len(docs.columns)] == docs.columns and len(got) == n
        assert {(r["we.ird"], r["a b"], r["c0"], r["TEXT_"]) for r in got} == {("x", 1, 2, 3)}

    same(mark(docs, items), 40)
    same(remove_contaminated(docs, items), 39)
    same(remove_boilerplate(docs), 40)
    machine = train(docs, labels, label_col="quality", max_rows=100)
    same(score(docs, machine, keep=docs.columns), 40)
    same(langid.identify(docs, langid.train(docs), keep=docs.columns), 40)
    same(keep_one(docs, shingle=5, similarity=0.8), 40)
    assert pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, limits=Limits(64, 8, 64)).count() >= 40
