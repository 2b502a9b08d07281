"""The inverted file against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import ann, vectors
from quarrylight.session import shared_folder


def brute(vs, qs, k):
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    ids, v = list(vs), unit(np.array(list(vs.values())))
    out = {}
    for i, q in qs.items():
        cosine = np.round(v @ unit(np.array([q]))[0], 6) + 0.0
        out[i] = [(ids[j], cosine[j]) for j in sorted(range(len(ids)), key=lambda j: (-cosine[j], ids[j]))[:k]]
    return out


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.cosine))
    return out


@pytest.fixture(scope="module")
def data(spark):
    """A third of all vectors are one, so that a list is hot; some are zero."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    vs = {i: centre[i % 12] + 0.6 * rng.normal(size=16) if i % 3 else centre[0] for i in range(1500)} | {1500: np.zeros(16), 1501: np.zeros(16)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vs.items()] + [(9999, None)], "id long, vector array<double>").repartition(4)
    return vs, df


def test_inverted_file(spark, data, monkeypatch):
    monkeypatch.setattr(ann, "PART", 100)
    monkeypatch.setattr(ann, "BLOCK", 7)
    vs, df = data
    index = ann.build(df, shared_folder(spark, "ivf"), lists=40)
    assert index.vectors.count() == len(vs) and index.vectors.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 200
    qs = {i: vs[i] for i in vs if i % 50 == 0} | {7777: np.zeros(16)}
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in qs.items()] + [(8888, None)], "query_id long, query array<double>")
    want = brute(vs, qs, 10)
    assert rows(ann.search_exact(index, asked, 10, shared_folder(spark, "first"), probes=2)) == want
    got = rows(ann.search(index, asked, 10, probes=10))
    recall = np.mean([len({c for _, c in got[i]} & {c for _, c in want[i]}) / len({c for _, c in want[i]}) for i in want if i != 7777])
    assert recall >= 0.9
    assert rows(vectors.nearest(df, asked, 10, block=3)) == want


def test_recall_on_the_table(spark):
    from quarrylight.plans import catalogue

    want = {(r.query_id, r.id) for r in catalogue.knn_exact(spark, "/root/testdata/sf0.1").collect()}
    got = {(r.query_id, r.id) for r in catalogue.ivf_approximate(spark, "/root/testdata/sf0.1").collect()}
    exact = {(r.query_id, r.id) for r in catalogue.ivf_exact(spark, "/root/testdata/sf0.1").collect()}
    assert len(want) == 400 and exact == want and len(want & got) / len(want) >= 0.9


def test_nothing_to_search(spark, data):
    none = data[1].limit(0)
    index = ann.build(none, shared_folder(spark, "ivf"))
    asked = data[1].limit(3).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    assert not ann.search(index, asked, 5).collect() and not vectors.nearest(none, asked, 5).collect()
    some = ann.build(data[1], shared_folder(spark, "ivf"), lists=5)
    assert not ann.search(some, asked.limit(0), 5).collect() and not vectors.nearest(data[1], asked.limit(0), 5).collect()
