"""Near copies: texts whose sets of word shingles have at least a given Jaccard similarity, found exactly.

Two such sets share one of their least shingle hashes, so each set is filed under these: no pair is lost. In a file, sizes,
the place of the shared hash and 256 SimHash bits of the sets sort candidates out, tile by tile.

1. For each set of a file the nearest candidate by these bits is confirmed by the sets themselves in a join. This
   connects most of a group, whether its members resemble each other or only one of them.
2. Among what is still apart, each file gives a spanning forest of its candidates; these join into clusters, which hold
   every link that is left. A cluster's sets are compared tile by tile, exactly, where a candidate is not connected yet.

So the rows that any step makes grow with the rows filed, not with the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quarrylight.llm.common import alone, discard, fresh, prepare, written
from quarrylight.llm.components import connected_components
from quarrylight.llm.simhash import TILE, by_group, deal, hashes, majority, merge, near_duplicates

#: Of 256 bits, texts of Jaccard similarity 0.8 differ in 39 on average (48 in the worst case, four shingles beside five), by 6 more or less.
FAR = 80
#: Sets of a file, and sets and hashes of a cluster, that one group may have of each part.
PART, SETS, HASHES = 8192, 2048, 1 << 20
BITS = ["fp", "w1", "w2", "w3"]


def four(own: np.ndarray) -> list[int]:
    """256 SimHash bits of hashes: of themselves, and of them mixed anew three times."""
    out = [majority([own])]
    for j in range(3):
        x = (own + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(majority([x ^ (x >> np.uint64(32))]))
    return out


def shingle_sets(
    docs: DataFrame,
    similarity: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    seed: int = 42,
    whole: bool = False,
) -> DataFrame:
    """(doc_id, tie, node, n, fp, w1, w2, w3, hashes) of every row: node names the set of its n distinct shingles, the bits are
    of that set, tie is a hash of the text. hashes: the set's least ones, as many as two sets of this similarity cannot both
    have without a common one; whole: all, and no bits. A null text has no shingle.
    """
    prepare(docs.sparkSession)
    ratio = Fraction(similarity).limit_denominator(1000)
    kind = "doc_id long, tie long, node long, n long, fp long, w1 long, w2 long, w3 long, hashes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(lo, 1000)
                ints, kept = np.zeros((batch.num_rows, 6), np.int64), []
                for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                    parts = list(hashes(t, shingle, seed))
                    own = np.unique(
                        np.concatenate(parts).view(np.int64)
                    ).view(np.uint64) if parts else np.zeros(0, np.uint64)
                    n = len(own)
                    ints[i, :2] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed)).view(np.int64), n
                    if not whole:
                        ints[i, 2:] = np.array(four(own), np.uint64).view(np.int64)
                        own = own[: n + 1 + (-ratio.numerator * n // ratio.denominator)]
                    kept.append(own.view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(h) for h in kept])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64))
                )
                columns = [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array(np.ascontiguousarray(ints[:, j])) for j in range(6)),
                    lists
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kind.split(", ")])

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")
    )
    return source.mapInArrow(run, kind)


class Tiles:
    """Sets side by side: the pairs of two tiles that may be similar.

    n: sizes, bits: four words each, part: pairs of one part are left out if there are two, place: of the shared hash in each set.
    """

    def __init__(
        self, ratio: Fraction, n: np.ndarray, bits: np.ndarray, part: np.ndarray, place: np.ndarray | None = None
    ):
        self.num, self.both, self.den = ratio.numerator, ratio.numerator + ratio.denominator, ratio.denominator
        self.n, self.bits, self.part, self.left = n, np.ascontiguousarray(bits).view(np.uint64), part, None if place is None else n - place
        self.cross = len(part) > 0 and part.min() != part.max()

    def near(self, x: slice, y: slice, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Which pairs may be similar and have not one label, and their distances; None if there is none."""
        a, b = self.n[x, None], self.n[None, y]
        ok = np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num
        if label is not None:
            ok &= label[x, None] != label[None, y]
        if self.cross:
            ok &= self.part[x, None] != self.part[None, y]
        # were the shared hash the first one, no more than what is left of each could be common
        if self.left is not None:
            ok &= np.minimum(self.left[x, None], self.left[None, y]) * self.both >= (a + b) * self.num
        if not ok.any():
            return None
        far = sum(np.bitwise_count(self.bits[x, None, c] ^ self.bits[None, y, c]).astype(np.int16) for c in range(4))
        ok &= far <= FAR
        return (ok, far) if ok.any() else None

    def walk(self) -> Iterator[tuple[slice, slice]]:
        edges = [slice(i, min(i + TILE, len(self.n))) for i in range(0, len(self.n), TILE)]
        for i, x in enumerate(edges):
            for y in edges[i:]:
                yield x, y


def _nearest(t: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """Each set and the nearest that it may be similar to."""
    best, other = np.full(len(t.n), 1 << 14, np.int16), np.full(len(t.n), -1)
    for x, y in t.walk():
        if (got := t.near(x, y, None)) is None:
            continue
        ok, far = got
        if x == y:
            np.fill_diagonal(ok, False)
        far = np.where(ok, far, 1 << 14).astype(np.int16)
        for side, axis, start in ((x, 1, y.start), (y, 0, x.start)):
            least = far.min(axis=axis)
            better = np.flatnonzero(least < best[side])
            best[side.start + better] = least[better]
            other[side.start + better] = far.argmin(axis=axis)[better] + start
    some = np.flatnonzero(other >= 0)
    return some, other[some]


def _candidate_forest(t: Tiles, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what candidates of different labels connect."""
    _, number = np.unique(label, return_inverse=True)
    tree = np.arange(len(label))
    for x, y in t.walk():
        if any((z[x] == z[x.start]).all() and (z[y] == z[x.start]).all() for z in (label, tree)):
            continue
        if (got := t.near(x, y, number)) is not None:
            u, v = np.nonzero(got[0])
            merge(tree, u + x.start, v + y.start)
    far = np.flatnonzero(tree != np.arange(len(label)))
    return far, tree[far]


def _in_files(files: DataFrame, ratio: Fraction, labelled: bool) -> DataFrame:
    """Pairs (a, b) of nodes of a file's groups, once, with a < b. files: (file, p, q, part, node, n, place, fp, w1, w2, w3, label)."""
    names = ["file", "p", "q", "part", "node", "n", "place", *BITS, "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            got = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(got[:, c])) for c in range(2)], names=["a", "b"]
            )

        found, held = [], 0
        for rows in by_group(batches, len(names), 3):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(rows[:, 4], kind="stable")]
            t = Tiles(ratio, rows[:, 5], rows[:, 7:11], rows[:, 3], rows[:, 6])
            x, y = _candidate_forest(t, rows[:, 11]) if labelled else _nearest(t)
            if len(x):
                found.append(np.column_stack([rows[x, 4], rows[y, 4]]))
                held += len(x)
            if held > 200_000:
                yield table()
                found, held = [], 0
        if held:
            yield table()

    return files.select(*names).repartition("file", "p", "q").sortWithinPartitions("file", "p", "q").mapInArrow(
        run, "a long, b long"
    ).distinct()


def common(sets: list[np.ndarray], others: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many hashes the sets of each pair (positions in sets and others) have in common."""
    if len(pairs) <= 2 * (len(sets) + len(others)):
        return np.array(
            [len(np.intersect1d(sets[i], others[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64
        )
    size = [len(s) for s in [*sets, *others]]
    word, where = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(sets), len(others)), np.float32)
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    for lo in range(0, len(word), 4096):  # counts are whole numbers below 2**24, which these floats hold exactly
        a, b = np.searchsorted(where, [lo, lo + 4096])
        has = np.zeros((len(size), min(4096, len(word) - lo)), np.float32)
        has[row[a:b], where[a:b] - lo] = 1
        out += has[: len(sets)] @ has[len(sets) :].T
    return out[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _in_clusters(groups: DataFrame, ratio: Fraction) -> DataFrame:
    """Links (a, b) that connect the similar sets of clusters' groups. groups: (file, p, q, part, node, label, n, fp, w1, w2, w3, hashes)."""
    names = ["file", "p", "q", "part", "node", "label", "n", *BITS]

    def links(rows: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = Tiles(ratio, rows[:, 6], rows[:, 7:11], rows[:, 3])
        _, first, number = np.unique(rows[:, 5], return_index=True, return_inverse=True)
        start = first[number]  # a position for each label
        label = start.copy()
        for x, y in t.walk():
            if (label[x] == label[x.start]).all() and (label[y] == label[x.start]).all():
                continue
            if (got := t.near(x, y, label)) is None:
                continue
            u, v = np.nonzero(got[0])
            if x == y:
                u, v = u[u < v], v[u < v]
            if not len(u):
                continue
            left, right = np.unique(u), np.unique(v)
            pairs = np.column_stack([np.searchsorted(left, u), np.searchsorted(right, v)])
            both = common([sets[i + x.start] for i in left], [sets[j + y.start] for j in right], pairs)
            u, v = u + x.start, v + y.start
            same = both * (ratio.numerator + ratio.denominator) >= (t.n[u] + t.n[v]) * ratio.numerator
            u, v = u[same], v[same]
            if len(u):
                merge(label, u, v)
        far = np.unique(start[label[start] != start])
        return far, label[far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                rows = np.array([r[: len(names)] for r in held], np.int64)
                x, y = links(rows, [r[-1] for r in held])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[x, 4]), pa.array(rows[y, 4])], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            ints = [batch.column(c).to_pylist() for c in names]
            lists = batch.column("hashes")
            for i, r in enumerate(zip(*ints)):
                if held and held[-1][:3] != r[:3]:
                    yield from flush()
                    held = []
                held.append((*r, lists[i].values.to_numpy()))
        yield from flush()

    dealt = groups.select(*names, "hashes").repartition("file", "p", "q").sortWithinPartitions("file", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def _worth(filed: DataFrame, ratio: Fraction) -> DataFrame:
    """The files (file, node, n, place) that can hold a pair whose first common hash is theirs.

    Such a file has two sets, of which one has it among the first (1 - s) / (1 + s) of its hashes. Of files with the same sets the one of
    the least hash stays: it is the first common hash if any of them is.
    """
    # so that Spark sees its size
    shared = written(filed.groupBy("file").agg(F.count("*").alias("size")).where("size > 1").select("file"), "shared")
    some = filed.join(shared, "file", "left_semi")
    early = F.col("place") * (ratio.numerator + ratio.denominator) <= F.col("n") * (ratio.denominator - ratio.numerator)
    same = ["_size", "_one", "_two"]
    of = some.groupBy("file").agg(
        F.count("*").alias("_size"),
        F.bit_xor("node").alias("_one"),
        F.bit_xor(F.xxhash64("node")).alias("_two"),
        F.count_if(early).alias("_early"),
    )
    kept = written(of.where("_early > 0").groupBy(*same).agg(F.min("file").alias("file")).select("file"), "kept")
    return some.join(kept, "file", "left_semi").withColumn("place", F.col("place").cast("long"))


def similar(
    docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5
) -> DataFrame:
    """(doc_id, tie, node, component_id) of every row: linked are texts whose sets of shingles have this Jaccard similarity or
    more. node: the same for all rows of a group that links connect; component_id: the group's least doc_id, null if none has
    one. tie: a hash of the text.

    Words are those between ASCII white space, A-Z lower-cased; fewer words than a shingle has make one. Null and empty texts
    are one set. Repeated rows each come back. An empty table gives no row. Further columns are not read, whatever their names.
    """
    ratio = Fraction(similarity).limit_denominator(1000)
    marked = written(shingle_sets(docs, similarity, id_col, text_col, shingle), "sets")
    # equal sets are one node; rep names one row of it, whose text gives the set again
    rep = F.min(F.struct("doc_id", "tie")).alias("rep")
    nodes = written(
        marked.groupBy("node").agg(
            F.min("doc_id").alias("least"), rep, *[F.first(c).alias(c) for c in ("n", *BITS, "hashes")]
        ),
        "nodes",
    )
    filed = nodes.select(F.posexplode("hashes").alias("place", "file"), "node", "n")
    files = written(deal(_worth(filed, ratio), PART, ["node"]).join(nodes.select("node", *BITS), "node"), "files")

    def whole(named: DataFrame, name: str) -> DataFrame:
        """(node, n, hashes) of these nodes: all hashes, from one text of each."""
        rows = nodes.join(named, "node", "left_semi").select(
            F.col("rep.doc_id").alias("_id"), F.col("rep.tie").alias("_tie")
        )
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        texts = source.join(
            rows, (F.xxhash64("text") == F.col("_tie")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
        )
        sets = shingle_sets(texts, similarity, shingle=shingle, whole=True)
        return written(sets.dropDuplicates(["node"]).select("node", "n", "hashes"), name)

    # nearest candidates, confirmed one by one
    pairs = written(_in_files(files.withColumn("label", F.col("node")), ratio, labelled=False), "nearest")
    sets = whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nearest_sets")
    left, right = (
        sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}")) for c in "ab"
    )
    both = F.size(F.array_intersect("ha", "hb")).cast("long") * (ratio.numerator + ratio.denominator)
    first = written(
        pairs.join(left, "a").join(right, "b").where(
            both >= (F.col("na") + F.col("nb")) * ratio.numerator
        ).select("a", "b"),
        "similar",
    )
    discard(pairs, sets)
    label = connected_components(first).select("node", F.col("component").alias("label"))

    # clusters of what may be similar and is apart
    labelled = files.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    cluster = connected_components(
        _in_files(labelled, ratio, labelled=True)
    ).select("node", F.col("component").alias("file"))
    gathered = whole(cluster.select("node"), "cluster_sets")
    members = cluster.join(gathered, "node").join(nodes.select("node", *BITS), "node")
    members = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = cluster.join(nodes.select("node", "n"), "node").groupBy("file").agg(
        F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / HASHES)).alias("k")
    )
    members = members.join(large, "file").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    groups = members.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    second = written(_in_clusters(groups, ratio), "similar")
    discard(files, gathered)

    found = connected_components(first.union(second))
    joined = nodes.select("node", "least").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    group = joined.join(least, "component").select("node", "component", "component_id")
    return marked.select("doc_id", "tie", "node").join(group, "node").select(
        "doc_id", "tie", F.col("component").alias("node"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float | None = None,
    **options
) -> DataFrame:
    """docs with one row of each group: of least id, then of least hash of its text, then of its columns.

    Groups are those of near_duplicates, or with a similarity those of similar. Rows are told apart by id and text, so rows
    of one id with different texts are judged each. Rows with a null id all stay. An empty table stays empty.
    """
    named = docs.where(F.col(id_col).isNotNull())
    if similarity is None:
        groups = near_duplicates(named, radius, id_col, text_col, **options)
    else:
        groups = similar(named, similarity, id_col, text_col, **options)
    chosen, nth = fresh(docs.columns, "_chosen", "_nth")
    kept = groups.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias(chosen)).select(chosen)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"))
    rows = docs.join(kept, own == F.col(chosen), "left_semi")
    order = Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.xxhash64(*columns))
    one = rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return one.select(*columns).union(docs.where(F.col(id_col).isNull()).select(*columns))
