"""Benchmark decontamination with suffix arrays over the training side.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Every Arrow batch of documents
is a shard. Of its word positions, those from which at least as many words as the shortest window has are all
words of the benchmark are sorted by their following words (a suffix array; no other position can begin
a match). Every suffix of every benchmark item that begins a window is then found in it by binary search.
Matches of one item at successive positions join into its longest verbatim matches, with their places in the
document and in the item, also where items share windows.

The benchmark travels to the executors in blocks of bounded size; documents pass all blocks, one after
the other, in one scan without a shuffle. A block's sorted windows are built once, on the driver, and broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylight.llm.common import alone, fresh, map_in_arrow, prepare

#: Upper to lower case; whatever is no part of a word to a space.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
SPAN = "struct<doc_start:bigint,words:bigint,item_id:string,item_start:bigint>"
RUN = "struct<start:bigint,words:bigint>"
MATCH = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,hits:array<{RUN}>,spans:array<{SPAN}>>"
#: Pairs of a window's place in a document and in an item that are held at a time.
HELD = 2_000_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Windows:
    """The benchmark's suffixes: each distinct window with all its places in items (number of the item, first word).

    Built once, on the driver: what travels is the items' words as ranks, the sorted vocabulary, and for each window
    length the sorted places (a suffix array of the benchmark). A worker only looks up, it sorts nothing.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        cut = [(name, w) for name, text in items if (w := words(text))]
        self.names, self.size = [name for name, _ in cut], size
        self.vocabulary = sorted({x for _, w in cut for x in w})
        rank = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.base = np.cumsum([0, *(len(w) for _, w in cut)])
        self.ids = np.fromiter((rank[x] for _, w in cut for x in w), np.uint32, self.base[-1])
        lengths = np.diff(self.base)
        self.sorted: dict[int, np.ndarray] = {}
        for n in np.unique(np.minimum(lengths, size)).tolist():
            chosen = np.flatnonzero(np.minimum(lengths, size) == n)
            count = lengths[chosen] - n + 1
            at = np.repeat(self.base[chosen] - np.cumsum(count) + count, count) + np.arange(count.sum())
            self.sorted[n] = at[np.argsort(self._keys(at, n), kind="stable")]
        self._look_up()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("names", "size", "vocabulary", "base", "ids", "sorted")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._look_up()

    def _keys(self, at: np.ndarray, n: int) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(self.ids, n)[at].astype(">u4")  # byte order sorts as numbers do
        return np.ascontiguousarray(windows).view(f"S{4 * n}").reshape(-1)

    def _look_up(self) -> None:
        # 0: no word of the benchmark
        self.rank = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.shortest, self.by_length = min(self.sorted, default=0), {}
        for n, at in self.sorted.items():
            keys = self._keys(at, n)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(first, len(keys)))
            # windows at the places before and behind each place of the same item, for the ends of a match
            number = np.full(len(self.ids) + 2, -2)
            number[at + 1] = np.repeat(np.arange(len(first)), count)
            item = np.searchsorted(self.base, at, side="right") - 1
            before = np.where(at > self.base[item], number[at], -2)
            behind = np.where(at + n < self.base[item + 1], number[at + 2], -2)
            self.by_length[n] = keys[first], first, count, np.stack([item, at - self.base[item], before, behind])


def shard_matches(w: Windows, ids: np.ndarray, depth: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: (length, positions, number of the window there). ids: ranks, with 0 between documents."""
    out = []
    if not w.shortest or not len(ids):
        return out
    blank = np.flatnonzero(ids == 0)
    following = np.append(blank, len(ids))[np.searchsorted(blank, np.arange(len(ids)))]
    start = np.flatnonzero(following - np.arange(len(ids)) >= w.shortest)
    if not len(start):
        return out
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(">u4")
    suffixes = np.ascontiguousarray(
        np.lib.stride_tricks.sliding_window_view(padded, depth)[start]
    ).view(f"S{4 * depth}").reshape(-1)
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    for n, (keys, *_) in w.by_length.items():
        heads = ranked  # the suffixes' first n words are in order too
        if n < depth:
            heads = np.ascontiguousarray(ranked.view(np.uint8).reshape(-1, 4 * depth)[:, : 4 * n]).view(f"S{4 * n}").reshape(-1)
        low, high = (np.searchsorted(heads, keys, side=side) for side in ("left", "right"))
        hit = np.flatnonzero(high > low)
        if len(hit):
            count = (high - low)[hit]
            flat = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at, which = start[order[flat]], np.repeat(hit, count)
            by = np.argsort(at)
            out.append((n, at[by], which[by]))
    return out


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _longest(
    w: Windows, n: int, at: np.ndarray, which: np.ndarray, doc: np.ndarray
) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, first position, words, first word in the item) of each longest match, some documents at a time.

    A pair of a position and a place in an item begins a match if the windows before them differ, and ends one if those
    behind them do. Only such pairs are kept, so words that repeat in both do not fill the memory.
    """
    _, first, count, places = w.by_length[n]
    joined = np.diff(at) == 1
    before = np.append(-1, np.where(joined, which[:-1], -1))
    behind = np.append(np.where(joined, which[1:], -1), -1)
    edges = np.empty((4, 0), np.int64), np.empty((4, 0), np.int64)
    for lo, hi, ahead, a, m in _shares(count[which], HELD):
        i = np.repeat(np.arange(lo, hi), m)
        item, j, earlier, later = places[:, np.repeat(first[which[lo:hi]] + a - np.cumsum(m) + m, m) + np.arange(m.sum())]
        new = [np.flatnonzero(before[i] != earlier), np.flatnonzero(behind[i] != later)]
        edges = tuple(
            np.hstack([old, np.stack([doc[i[e]], item[e], at[i[e]] - j[e], at[i[e]]])]) for old, e in zip(edges, new)
        )
        if ahead < len(at) and edges[0].shape[1] < HELD:
            continue
        # a match never leaves its document
        done = [x[0] < (doc[ahead] if ahead < len(at) else doc[-1] + 1) for x in edges]
        (d, item, diagonal, p), last = (x[:, np.lexsort(x[::-1])] for x in (e[:, k] for e, k in zip(edges, done)))
        edges = tuple(e[:, ~k] for e, k in zip(edges, done))
        if len(d):
            yield d, item, p, last[3] - p + n, p - diagonal


def _shares(count: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(from, to, first position not done after it, first entry, entries of each), about `most` entries at a time, in order.

    A position with more entries than that is divided.
    """
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        if count[lo] <= most:
            yield lo, hi, hi, 0, count[lo:hi]
        else:
            for a in range(0, int(count[lo]), most):
                m = min(most, int(count[lo]) - a)
                yield lo, hi, hi if a + m == count[lo] else lo, a, np.array([m])
        lo = hi


def _scan(w: Windows, texts: list[bytes | None]) -> list[dict]:
    cut, get = [words(t) for t in texts], w.rank.get
    lengths = np.array([len(x) for x in cut], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(cut) else lengths
    ids = np.zeros(int((lengths + 1).sum()), np.uint32)
    for at, x in zip(first.tolist(), cut):
        ids[at : at + len(x)] = [get(y, 0) for y in x]
    change = np.zeros(len(ids) + 1, np.int64)
    items: list[set] = [set() for _ in cut]
    best: list[dict] = [{} for _ in cut]
    for n, at, which in shard_matches(w, ids, w.size):
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        for found in _longest(w, n, at, which, np.searchsorted(first, at, side="right") - 1):
            for doc, item, p, size, j in zip(*(x.tolist() for x in found)):
                items[doc].add(item)
                held = best[doc].get(item)
                if held is None or held[1] < size:
                    best[doc][item] = (p - int(first[doc]), size, w.names[item], j)
    starts, sizes = _runs(np.cumsum(change[:-1]) > 0)
    owner = np.searchsorted(first, starts, side="right") - 1
    hits: list[list] = [[] for _ in cut]
    for doc, a, n in zip(owner.tolist(), starts.tolist(), sizes.tolist()):
        hits[doc].append({"start": a - int(first[doc]), "words": n})
    keys = ("doc_start", "words", "item_id", "item_start")
    out = []
    for n, seen, runs, spans in zip(lengths.tolist(), items, hits, best):
        named = sorted((s for s in spans.values() if s[2] is not None), key=lambda s: (s[0], s[2], s[1]))
        out.append(
            {
                "n_words": n,
                "n_hit": sum(r["words"] for r in runs),
                "items": sorted({w.names[i] for i in seen} - {None}),
                "hits": runs,
                "spans": [dict(zip(keys, s)) for s in named],
            }
        )
    return out


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = 13,
    block_bytes: int = 32 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    out_col: str = "contamination",
) -> DataFrame:
    """The rows of docs with their columns `keep` (None: all) and a struct `out_col`: n_words, n_hit (words inside
    an occurrence of a window), items (ids as strings, sorted), hits (runs of such words), spans (each item's longest match, the
    first of equal ones: first word in the document, words, item, first word in the item).

    An item of fewer words than a window is one window; an item without words is none. A null text has no words.
    Repeated rows are marked each. A column named like out_col is replaced. With no items nothing is hit. Words of an item
    with a null id count as hit, but it is in neither items nor spans. Items of one id are one in items.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    bytes_all = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-bytes_all // block_bytes))
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    carried = list(dict.fromkeys([*keep, text_col]))
    out = docs.select(*[F.col(f"`{c}`") for c in carried])
    run = uuid.uuid4().hex
    kind = T._parse_datatype_string(MATCH)
    for block in range(blocks):
        # at most about block_bytes
        some = [
            (r.i, bytes(r.t) if r.t is not None else None)
            for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        ]
        sent, last = spark.sparkContext.broadcast(Windows(some, window)), block == blocks - 1
        names = keep if last else carried
        schema = T.StructType([*(out.schema[c] for c in names), T.StructField(out_col, kind)])
        out = map_in_arrow(out, _marker(sent, f"{run} {block}", names, text_col, out_col, schema), schema)
    return out


def _merge(a: dict, b: dict) -> dict:
    """Of two blocks of the benchmark. Words hit by both count once."""
    runs: list[dict] = []
    for r in sorted(a["hits"] + b["hits"], key=lambda r: r["start"]):
        if runs and r["start"] <= runs[-1]["start"] + runs[-1]["words"]:
            runs[-1]["words"] = max(runs[-1]["words"], r["start"] + r["words"] - runs[-1]["start"])
        else:
            runs.append(dict(r))
    spans = sorted(a["spans"] + b["spans"], key=lambda s: (s["doc_start"], s["item_id"], s["words"]))
    return {
        "n_words": a["n_words"],
        "n_hit": sum(r["words"] for r in runs),
        "items": sorted({*a["items"], *b["items"]}),
        "hits": runs,
        "spans": spans,
    }


def _marker(sent, key: str, names: list[str], text_col: str, out_col: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(schema[out_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        w = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                found = _scan(w, batch.column(text_col).cast(pa.binary()).to_pylist())
                if out_col in batch.schema.names:
                    found = [_merge(a, b) for a, b in zip(batch.column(out_col).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(found, arrow)], names=[*names, out_col]
                )

    return run


def contaminated(out_col: str = "contamination", times: int = 20) -> F.Column:
    """Hit, and one word of `times` or more is."""
    return (F.col(f"{out_col}.n_hit") > 0) & (times * F.col(f"{out_col}.n_hit") >= F.col(f"{out_col}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without its contaminated rows, with the same columns. Nulls, empty tables and repeated rows as in mark."""
    (name,) = fresh(docs.columns, "_contamination")
    return mark(
        docs, benchmark, out_col=name, **options
    ).where(~contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])
