"""Vectors in array columns: products, exact nearest neighbours, hashed text embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarrylight.functions.text import tokens
from quarrylight.session import filesystem, for_workers, shared_folder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def unit(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def affine(cosine: Column) -> Column:
    """From -1..1 to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1) / 2))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", block: int = 2000) -> DataFrame:
    """The k vectors of largest cosine (6 decimals) for each query (query_id, query), ties by id: (query_id, rank, id, cosine).

    Queries are written to the shared folder once, in unit length; a task multiplies some ten thousand vectors at a time with one block
    of queries after the other, as it reads them there. So no more than a block of queries is held anywhere, the vectors are scanned
    once however many queries there are, and at most k rows for each query leave such a step. All arrays have one length; null ones are
    left out; no vectors or no queries give no row.
    """
    spark = for_workers(vectors.sparkSession)
    left = vectors.select(
        F.col(id_col).alias("id"), F.col("vector").cast("array<double>").alias("v")
    ).where("v is not null")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("q")).where("q is not null")
    path = shared_folder(spark, "queries")
    asked.write.parquet(path)
    schema = T.StructType([asked.schema["query_id"], left.schema["id"], T.StructField("cosine", T.DoubleType())])
    found = left.mapInArrow(_products(path, k, block), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn(
        "rank", F.row_number().over(order)
    ).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def unit_rows(column) -> np.ndarray:
    """An Arrow column of lists as rows of length 1; zero vectors stay."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def closest(q: np.ndarray, v: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of the k vectors of largest cosine (6 decimals) for each query, ties by id; unit rows."""
    cosine = np.round(q @ v.T, 6) + 0.0
    rank = np.argsort(np.argsort(np.array(ids.to_pylist(), object), kind="stable"), kind="stable")  # ids in their own order
    n = min(k, len(v))
    least = -np.partition(-cosine, n - 1, axis=1)[:, n - 1]
    x, y = np.nonzero(cosine >= least[:, None])  # all ties with the k-th
    order = np.lexsort((rank[y], -cosine[x, y], x))
    x, y = x[order], y[order]
    near = np.arange(len(x)) - np.searchsorted(x, x) < k
    x, y = x[near], y[near]
    return x, y, cosine[x, y]


def _products(path: str, k: int, block: int, held: int = 16_384):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        where, inside = filesystem(path)
        queries = ds.dataset(inside, filesystem=where, format="parquet", exclude_invalid_files=False)

        def answer(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([b.column(0) for b in some])
            v = np.concatenate([unit_rows(b.column(1)) for b in some])
            for asked in queries.to_batches(columns=["query_id", "q"], batch_size=block):
                for lo in range(0, asked.num_rows, 256):
                    few = asked.slice(lo, 256)
                    x, y, cosine = closest(unit_rows(few.column(1)), v, ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [few.column(0).take(pa.array(x)), ids.take(pa.array(y)), pa.array(cosine)], names=["query_id", "id", "cosine"]
                    )

        some: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
            if sum(b.num_rows for b in some) >= held:
                yield from answer(some)
                some = []
        if some:
            yield from answer(some)

    return run


def hash_embedding(chunks: DataFrame, dimensions: int = 384, text_col: str = "content") -> DataFrame:
    """Adds vector: signed counts of tokens and bigrams by BLAKE2b, made unit length. No token: zeros.

    Tokens are native columns; they cross to Python once, bigrams are pairs of their numbers there, each distinct feature is digested
    once a batch, and a batch's counts are added up together.
    """
    if dimensions < 32:
        raise ValueError("32 dimensions at least")
    for_workers(chunks.sparkSession)
    kept = [f for f in chunks.schema.fields if f.name != "vector"]
    name = "_words"
    while name in chunks.columns:
        name += "_"
    source = chunks.select(*[f"`{f.name}`" for f in kept], tokens(F.coalesce(F.col(text_col), F.lit(""))).alias(name))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lists = batch.column(len(kept))
                encoded = lists.flatten().dictionary_encode()
                at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                words = encoded.dictionary.to_pylist()
                row = np.repeat(
                    np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                )
                pair, where = np.unique((at[:-1] * len(words) + at[1:])[row[:-1] == row[1:]], return_inverse=True)
                both = [f"{words[p // len(words)]}::{words[p % len(words)]}" for p in pair.tolist()]
                out = np.zeros((batch.num_rows, dimensions))
                for features, owner, number in ((words, row, at), (both, row[1:][row[:-1] == row[1:]], where)):
                    raw = b"".join(hashlib.blake2b(f.encode(), digest_size=16).digest() for f in features)
                    digest = np.frombuffer(raw, np.uint8).reshape(-1, 16)
                    bucket = (
                        np.ascontiguousarray(digest[:, :8]).view(">u8").reshape(-1) % np.uint64(dimensions)
                    ).astype(np.int64)
                    sign = np.where(digest[:, 8] & 1, 1.0, -1.0)
                    if len(features):
                        cell = owner * dimensions + bucket[number]
                        out += np.bincount(cell, sign[number], out.size).reshape(out.shape)
                n = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out = np.divide(out, n, out=out, where=n > 0)
                vector = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, out.size + 1, dimensions, dtype=np.int32)), pa.array(out.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), vector], names=[*(f.name for f in kept), "vector"]
                )

    return source.mapInArrow(embed, T.StructType([*kept, T.StructField("vector", T.ArrayType(T.DoubleType()))]))
