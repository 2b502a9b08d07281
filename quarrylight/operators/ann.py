"""Approximate nearest neighbours: an inverted file of vectors by their nearest centre, searched list by list.

Centres are spherical means, fitted by Spark to a bounded sample; every vector is filed under its nearest one. A large list is
dealt into parts, and the queries that ask for one list into blocks, so no group of the search's join grows with the corpus, whatever
share of it one list has. The exact search starts the same way and then visits each list whose angle from the query, less
the list's own radius, leaves room for something nearer than what is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quarrylight.operators.vectors import closest, unit_rows
from quarrylight.session import for_workers

#: Vectors of a part of a list, and queries of a block.
PART, BLOCK = 8192, 2048
MOST_LISTS = 65_536


@dataclass(frozen=True)
class Index:
    """centres: (lists, dimensions), unit rows. vectors: (list, part, id, v). lists: (list, rows, parts, widest) of each list that has
    vectors; widest: the least cosine of one of its vectors with its centre."""

    centres: np.ndarray
    vectors: DataFrame
    lists: DataFrame


def _lists_for(rows: int) -> int:
    return int(max(1, min(MOST_LISTS, rows**0.5, rows / 8)))


def _nearest_centre(centres, name: str):
    """For each Arrow batch of (id, v): the list of each vector and the cosine with its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                v = unit_rows(batch.column(1))
                cosine = v @ c.T
                at = cosine.argmax(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1] or 1)[: len(v) + 1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists, pa.array(at, pa.int32()), pa.array(cosine[np.arange(len(at)), at])],
                    names=["id", "v", name, "cosine"],
                )

    return run


def _usable(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_LISTS rows
    kind = T.StructType([rows.schema["id"], rows.schema["v"], *T.StructType.fromDDL("list int, cosine double")])
    return rows.mapInArrow(_nearest_centre(sent, "list"), kind)


def fit(vectors: DataFrame, lists: int | None = None, sample: int = 262_144, rounds: int = 6, id_col: str = "id") -> np.ndarray:
    """Centres of the lists, (lists, dimensions), fitted to at most about `sample` vectors: those of least hash of their id.

    They start as the vectors of least hash; in each round Spark sums up the vectors of each list, and a centre becomes the
    direction of its sum; one without vectors stays. lists: None for the square root of the rows.
    """
    spark = for_workers(vectors.sparkSession)
    rows = _usable(vectors, id_col)
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    lists = min(lists or _lists_for(n), n)
    if lists > MOST_LISTS:
        raise ValueError(f"{MOST_LISTS} lists at most")
    order = F.xxhash64("id", "v")
    if n > sample:
        rows = rows.where(F.shiftrightunsigned(order, 1) < int(sample / n * 2**63))
    first = rows.orderBy(order).limit(lists).select("v").toArrow().column("v")
    centres = unit_rows(first)
    for _ in range(rounds):
        sums = _assigned(rows, centres).groupBy("list").agg(*[F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(centres.shape[1])])
        new = centres.copy()
        for r in sums.collect():  # a row for each list
            s = np.array(r[1:], float)
            if (norm := np.sqrt(s @ s)) > 0:
                new[r[0]] = s / norm
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "id", **options) -> Index:
    """Files every vector (id, vector) under its nearest centre and writes the index below path. Null vectors are left out."""
    spark = for_workers(vectors.sparkSession)
    centres = fit(vectors, lists, id_col=id_col, **options)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, v array<double>").coalesce(1).write.parquet(f"{path}/centres")
    rows = _usable(vectors, id_col)
    kind = T.StructType([rows.schema["id"], rows.schema["v"], *T.StructType.fromDDL("list int, cosine double")])
    filed = _assigned(rows, centres) if len(centres) else spark.createDataFrame([], kind)
    filed.write.parquet(f"{path}/filed")
    filed = spark.read.schema(kind).parquet(f"{path}/filed")
    told = filed.groupBy("list").agg(F.count("*").alias("rows"), F.min("cosine").alias("widest"))
    told.withColumn("parts", F.ceil(F.col("rows") / PART).cast("int")).coalesce(1).write.parquet(f"{path}/lists")
    told = spark.read.parquet(f"{path}/lists")
    # `told` has a row for each list: MOST_LISTS at most
    dealt = filed.join(F.broadcast(told.select("list", "parts")), "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v"
    )
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/vectors")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow().column("v")
    return Index(unit_rows(centres), spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists"))


def _probes(asked: DataFrame, index: Index, choose, columns: list[str]) -> DataFrame:
    """(query_id, q, list) of the lists that choose(cosines with all centres, batch) marks for each query."""
    sent = asked.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                marked = choose(unit_rows(batch.column(1)) @ sent.value.T, batch)
                x, y = np.nonzero(marked)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(x)), batch.column(1).take(pa.array(x)), pa.array(y, pa.int32())],
                    names=["query_id", "q", "list"],
                )

    kind = T.StructType([asked.schema["query_id"], asked.schema["q"], T.StructField("list", T.IntegerType())])
    return asked.select("query_id", "q", *columns).mapInArrow(run, kind)


def _visit(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """The k best of each list's part for each query that asks for the list: (query_id, id, cosine)."""
    asked = wanted.groupBy("list").agg(F.count("*").alias("queries"))
    sizes = index.lists.select("list", "parts").join(asked, "list").select(
        "list", "parts", F.ceil(F.col("queries") / BLOCK).cast("int").alias("blocks")
    )
    sizes = F.broadcast(sizes)  # a row for each list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(sizes, "list").select(
        "list", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "q"
    )
    right = index.vectors.join(sizes.select("list", "blocks"), "list").select("list", "part", every("blocks").alias("block"), "id", "v")

    def best(queries: pa.Table, some: pa.Table) -> pa.Table:
        found = [([], [], [])]
        if queries.num_rows and some.num_rows:
            ids, v = some.column("id").combine_chunks(), unit_rows(some.column("v"))
            for lo in range(0, queries.num_rows, 256):
                part = queries.slice(lo, 256)
                x, y, cosine = closest(unit_rows(part.column("q")), v, ids, k)
                found.append((part.column("query_id").take(pa.array(x)), ids.take(pa.array(y)), cosine))
        kinds = (queries.schema.field("query_id").type, some.schema.field("id").type, pa.float64())
        return pa.table(
            [pa.chunked_array([c for f in found for c in (f[i].chunks if isinstance(f[i], pa.ChunkedArray) else [pa.array(f[i], kinds[i])])], kinds[i]) for i in range(3)],
            names=["query_id", "id", "cosine"],
        )

    kind = T.StructType([wanted.schema["query_id"], index.vectors.schema["id"], T.StructField("cosine", T.DoubleType())])
    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, kind)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("query").cast("array<double>").alias("q")).where("q is not null")


def search(index: Index, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """The k vectors of largest cosine (6 decimals) in the `probes` lists nearest to each query (query_id, query), ties by id:
    (query_id, rank, id, cosine). Each query_id once; null queries are left out."""
    for_workers(queries.sparkSession)
    if not len(index.centres):
        return _top(_nothing(index, queries), k)
    probes = min(probes, len(index.centres))

    def choose(cosine: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        marked = np.zeros(cosine.shape, bool)
        np.put_along_axis(marked, np.argpartition(-cosine, probes - 1, axis=1)[:, :probes], True, axis=1)
        return marked

    return _top(_visit(index, _probes(_asked(queries), index, choose, []), k), k)


def _nothing(index: Index, queries: DataFrame) -> DataFrame:
    kind = T.StructType([queries.schema["query_id"], index.vectors.schema["id"], T.StructField("cosine", T.DoubleType())])
    return queries.sparkSession.createDataFrame([], kind)


def search_exact(index: Index, queries: DataFrame, k: int, path: str, probes: int = 8) -> DataFrame:
    """As search, but exact: lists that may hold something nearer are visited, too. path: a new folder for what the first visit finds.

    A list's vectors are within its widest angle of its centre, so none is nearer to a query than that angle less.
    """
    spark = for_workers(queries.sparkSession)
    if not len(index.centres):
        return _top(_nothing(index, queries), k)
    search(index, queries, k, probes).write.parquet(path)
    first = spark.read.parquet(path)
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    asked = _asked(queries).join(known, "query_id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)))
    widest = np.full(len(index.centres), 2.0)  # a list without vectors is not visited
    for r in index.lists.select("list", "widest").collect():  # a row for each list
        widest[r.list] = r.widest
    radius = np.where(widest <= 1.5, np.arccos(np.clip(widest, -1, 1)), -np.inf)
    n = min(probes, len(widest))

    def choose(cosine: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        reach = np.arccos(np.clip(cosine, -1, 1)) - radius[None, :]
        kth = batch.column(2).to_numpy(zero_copy_only=False)
        marked = np.cos(np.clip(reach, 0, np.pi)) + 2e-6 >= kth[:, None]
        marked[:, ~np.isfinite(radius)] = False
        np.put_along_axis(marked, np.argpartition(-cosine, n - 1, axis=1)[:, :n], False, axis=1)  # visited already
        return marked

    more = _visit(index, _probes(asked, index, choose, ["kth"]), k)
    return _top(first.select("query_id", "id", "cosine").unionByName(more), k)


def calibrate(index: Index, queries: DataFrame, k: int, path: str, recall: float = 0.95, sample: int = 128) -> int:
    """The fewest probes that find a share of `recall` of the k nearest of a sample of the queries: those of least hash.

    The sample is searched exactly; what counts is at which place in a query's order of lists its neighbours' lists come. path: a
    new folder. Vectors of equal cosine count by the one that the exact search names.
    """
    if not len(index.centres):
        return 1
    asked = _asked(queries).orderBy(F.xxhash64("query_id")).limit(sample)
    named = asked.select("query_id", F.col("q").alias("query"))
    found = search_exact(index, named, k, f"{path}/first").select("query_id", "id")
    met = index.vectors.join(F.broadcast(found), "id").select("query_id", "list").collect()  # sample * k rows
    got = asked.select("query_id", "q").toArrow()
    cosine = unit_rows(got.column("q")) @ index.centres.T if got.num_rows else np.zeros((0, 1))
    place = dict(zip(got.column("query_id").to_pylist(), np.argsort(np.argsort(-cosine, axis=1), axis=1)))
    needed = sorted(int(place[r.query_id][r.list]) + 1 for r in met)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
