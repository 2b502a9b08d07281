"""The pipeline's stages on sf0.001, one after the other."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).cache()
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before
        kept.append(len(after))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").count() == 0 and 0 < kept[-1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in sorted(pieces, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in text.items()}


def test_rows_without_an_id_or_text(spark):
    """Each stage on rows without an id, without a text, repeated, and with an empty text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [
        (None, None, None, None, None),
        (10**9, None, None, None, None),
        (10**9, None, None, None, None),
        (10**9 + 1, "", "en", "s", 0)
    ]
    odd = docs.union(spark.createDataFrame(rows, docs.schema)).cache()
    without = F.coalesce("text", F.lit("")) == ""
    blank = Counter((r.doc_id, r.text) for r in odd.where(without).collect())
    stages = dict(corpus_pipeline.STAGES)

    def left(name):
        return Counter((r.doc_id, r.text) for r in stages[name](spark, odd, SF).where(without).collect())

    assert left("quality_classifier") in (blank, Counter())  # alike, so judged alike
    assert left("line_dedup") == blank and left("decontamination") == blank
    least = min(i for i, _ in blank if i is not None)
    assert Counter(i for i, _ in left("near_dedup").elements()) == Counter([None, least])
    pieces = stages["packing"](spark, odd, SF).where("doc_tokens = 1").collect()
    assert Counter(r.doc_id for r in pieces) == Counter(i for i, _ in blank.elements())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
