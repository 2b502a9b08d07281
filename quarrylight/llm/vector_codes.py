"""Vector codes: vectors of whole numbers cut into parts, each part coded as its codebook's nearest entry.

The numbers are written once as columnar blocks: a row of the blocks table holds some thousand vectors, one
dimension after the other. A round is one treeAggregate over these: each block's squared distances grow dimension
by dimension, np.add.at sums its vectors into int64 tensors of sums and counts, and the tensors merge through a
reduction tree. All of it is exact in whole numbers, so neither blocks nor the order of merging change a codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrylight.llm.common import discard, fresh, prepare, written

#: Vectors of a block, and the size of a number below which squared distances of 64 dimensions a part fit a long.
BLOCK, LARGEST = 4096, 1 << 28
#: A group with at least one in this many rows is large: its total is broadcast. There are at most as many such groups.
SHARE = 1000


def whole(vector: Column, scale: int) -> Column:
    """The numbers of a vector: floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and without a null, NaN or infinite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def numbers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow column are usable, and their numbers: (dims, vectors), one row for each dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    sized = np.maximum(length, 0)
    bad = np.zeros(len(length) + 1, np.int64)
    owner = np.repeat(np.arange(len(length)), sized)
    np.add.at(bad, owner[~np.isfinite(flat)], 1)
    good = (length >= 0) & (bad[:-1] == 0)
    if (length[good] != dims).any():
        raise ValueError(f"vectors of {dims} and of {length[good][length[good] != dims][0]} components in one table")
    x = np.floor(flat[good[owner]].reshape(-1, dims) * scale).T
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    return good, np.ascontiguousarray(x, np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a part the nearest entry (the first of equally near ones) and the squared distance.

    x: (dimensions, vectors); entries: (entries, dimensions). Distances grow one dimension at a time.
    """
    far = np.zeros((len(entries), x.shape[1]), np.int64)
    for values, centre in zip(x, entries.T):
        step = values[None, :] - centre[:, None]
        step *= step
        far += step
    code = far.argmin(axis=0)
    return code, far[code, np.arange(x.shape[1])]


def blocks(df: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(n, x) of each block: its number of vectors, and its numbers dimension by dimension as little-endian longs of 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(xs: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(xs, axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([x.shape[1]], pa.int64()), pa.array([x.astype("<i4").tobytes()], pa.binary())], names=["n", "x"]
            )

        held: list[np.ndarray] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                _, x = numbers(batch.column(0).slice(lo, BLOCK), dims, scale)
                if x.shape[1]:
                    held.append(x)
                if sum(h.shape[1] for h in held) >= BLOCK:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return df.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "n long, x binary")


def _add(tensors: tuple[np.ndarray, np.ndarray], block, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = tensors
    parts, _, width = books.shape
    x = np.frombuffer(block.x, "<i4").reshape(parts, width, block.n).astype(np.int64)
    for part in range(parts):
        code, _ = nearest(x[part], books[part])
        np.add.at(counts[part], code, 1)
        for d in range(width):
            np.add.at(sums[part, :, d], code, x[part, d])
    return sums, counts


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def train(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> np.ndarray | None:
    """Codebooks: whole numbers (parts, entries, dimensions of a part). None: no vector is usable.

    They start as the parts of the `entries` usable rows of least id (null ids last, ties by the vector); with fewer rows
    there are fewer entries. A round sends every part to its nearest entry and makes each entry the floor of its
    parts' mean; an entry without parts stays. A round that changes nothing is the last, as all further ones would repeat it.
    Repeated rows count each. Vectors of unequal lengths, of a length that `parts` does not divide, or with a component of
    2**28 / scale or more are an error. No other column is read, whatever its name.
    """
    spark = prepare(df.sparkSession)
    v = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(usable(F.col("v")))
    rows = rows.select("id", whole(F.col("v"), scale).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows
    if not first:
        return None
    dims = len(first[0].v)
    if not dims or dims % parts or any(len(r.v) != dims for r in first):
        raise ValueError(f"vectors of {sorted({len(r.v) for r in first})} components do not make {parts} equal parts")
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    if np.abs(books).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    table = written(blocks(df, vector_col, dims, scale), "blocks")
    data = table.rdd
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = data.treeAggregate(zero, lambda t, block: _add(t, block, sent.value), _merge, depth=3)
        means = sums // np.maximum(counts, 1)[:, :, None]  # numpy's // goes down
        new = np.where(counts[:, :, None] > 0, means, books)
        sent.unpersist()
        if (new == books).all():
            break
        books = new
    discard(table)
    return books


def digest(books: np.ndarray) -> str:
    """Hexadecimal SHA-256 of all entries' numbers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    df: DataFrame,
    books: np.ndarray | None,
    keep: list[str],
    vector_col: str = "embedding",
    scale: int = 4096,
    code_col: str = "code",
    error_col: str = "error",
) -> DataFrame:
    """The columns `keep` of the usable rows, with the code (two hexadecimal digits for each part) and the error (squared
    distances, summed over parts).

    One scan without a shuffle. Rows with a null vector or a null, NaN or infinite component go; repeated rows each come back;
    columns named like the two new ones are replaced. Without codebooks (None) there is no row.
    """
    keep = [c for c in keep if c not in (code_col, error_col)]
    prepare(df.sparkSession)
    # kept columns travel in one, so that their names meet no other
    own = F.struct(F.lit(0).alias(fresh(keep, "none")[0]), *[F.col(f"`{c}`") for c in keep]).alias("own")
    source = df.select(own, F.col(f"`{vector_col}`").alias("v"))
    schema = T.StructType([source.schema["own"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{i:02x}" for i in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows if books is not None else 0, BLOCK):
                batch = whole_batch.slice(lo, BLOCK)
                parts, _, width = books.shape
                good, x = numbers(batch.column(1), parts * width, scale)
                code, error = np.full(x.shape[1], "", object), np.zeros(x.shape[1], np.int64)
                for part in range(parts):
                    entry, far = nearest(x[part * width : (part + 1) * width], books[part])
                    code, error = code + digits[entry], error + far
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(good)), pa.array(code, pa.string()), pa.array(error)],
                    names=["own", "code", "error"],
                )

    coded = source.mapInArrow(run, schema)
    return coded.select(
        *[F.col("own").getField(c).alias(c) for c in keep], F.col("code").alias(code_col), F.col("error").alias(error_col)
    )


def with_total(df: DataFrame, group_col: str, value_col: str, total_col: str) -> DataFrame:
    """Adds to each row the sum of value_col over its group; null groups are one. df is read four times: pass a written table.

    Totals of large groups (a thousandth of all rows or more, so a thousand groups at most) are broadcast; rows of the
    others meet theirs in a shuffle, in which no group has more than that share.
    """
    total, many, group = fresh([*df.columns, total_col], "_total", "_rows", "_group")
    totals = df.groupBy(F.col(f"`{group_col}`").alias(group)).agg(F.sum(value_col).alias(total), F.count("*").alias(many))
    least = -(-df.count() // SHARE)
    large = F.broadcast(totals.where(F.col(many) >= least))
    same = F.col(f"`{group_col}`").eqNullSafe(F.col(group))
    columns = [F.col(f"`{c}`") for c in df.columns if c != total_col]
    hot = df.join(large, same).select(*columns, F.col(total).alias(total_col))
    rest = df.join(large, same, "left_anti").join(totals.where(F.col(many) < least), same)
    return hot.unionByName(rest.select(*columns, F.col(total).alias(total_col)))
