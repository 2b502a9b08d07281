"""Periodic runs of words: all maximal repetitions of every text, by its longest previous factors.

A run is a stretch of words with smallest period q (words q apart are equal), of 2 q words or more, that no
neighbouring word extends with this period. The texts of a slice of an Arrow batch are worked on side by side, each with words
of its own, so that nothing matches across texts:

1. Prefix doubling sorts the suffixes. The ranks of each round name the stretches of 1, 2, 4, ... words: equal ranks are equal
   stretches, so they also tell how far two places agree, forwards and backwards, exactly.
2. Suffix array and LCP give every place's longest previous factor (LPF) and where it stands; these cut the text into
   LZ blocks: each is a word of its own or a copy of what starts earlier.
3. A run that touches a block's border is found by extending both ways from the border, for each period that two neighbouring
   blocks allow: if a run ends in a block, and the block before began a period or more behind the run's start, then that block
   would have reached the run's end, too.
4. A run strictly within a block is a copy of one further left; runs are kept in buckets by their start, and copied from left to right.

A text is never cut. Its memory grows with its words: some hundred bytes a word, and four for each doubling that finds repeats.
"""

from __future__ import annotations

from array import array as packed
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylight.llm.common import fresh, prepare

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Bytes of texts that are worked on side by side; a longer text is alone.
SLICE = 1 << 20


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of an Arrow column of texts, and each text's number of words. Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(size)), size)
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there), np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(size))


def doublings(names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes, and the ranks by their first 1, 2, 4, ... words as long as two are equal.

    names: longs, ordered by text first and unequal between texts. A rank is the number of suffixes before it. The rank of
    n stands behind the last place in each array.
    """
    n = len(names)
    order = np.argsort(names)
    tied, key, base = order, names[order], np.arange(n)
    rank, levels, h = np.full(n + 1, n, np.int32), [], 0
    while True:
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(tied)))
        rank[tied] = np.repeat(base[first], size)
        again = np.repeat(size > 1, size)
        if not again.any():
            return rank, levels
        levels.append(rank.copy())
        # those of equal rank keep their places in the order and are sorted by what follows
        tied, base, h = tied[again], base[again], 2 * h or 1
        key = rank[tied].astype(np.int64) * (n + 1) + rank[np.minimum(tied + h, n)]
        by = np.argsort(key)
        tied, key = tied[by], key[by]


def forwards(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For how many words the stretches from x and from y agree. A place of n agrees with none."""
    n, reach = len(levels[0]) - 1 if levels else 0, np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = x + reach, y + reach
        reach[(levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]) & (a < n) & (b < n)] += 1 << k
    return reach


def backwards(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For how many words the stretches that end at x and at y agree. A place under 0 agrees with none."""
    reach = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = x - reach - (1 << k) + 1, y - reach - (1 << k) + 1
        reach[(levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)]) & (a >= 0) & (b >= 0)] += 1 << k
    return reach


def previous_factors(rank: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each place's longest previous factor, and a place before it where that stands (0 where the factor is empty).

    The factor is shared with one of the two nearest suffixes in the suffix array that stand further left. Places whose word
    occurs once have none, and need not be looked at.
    """
    n = len(rank) - 1
    longest, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not levels:
        return longest, where
    array = np.empty(n, np.int64)
    array[rank[:n]] = np.arange(n)
    first = levels[0][array]
    same = np.zeros(n + 1, bool)
    same[1:n] = first[1:] == first[:-1]
    array = array[same[1:] | same[:-1]]  # the others match no word
    m = len(array)
    lcp = np.append(0, forwards(levels, array[:-1], array[1:]))
    best, source = packed("q", bytes(8 * m)), packed("q", bytes(8 * m))
    # those before the present one that may still be a nearest one: number, place, LCP with the one below in the stack
    number, places, shared = [-1], [-1], [0]
    for lo in range(0, m, 1 << 16):
        some = zip(array[lo : lo + (1 << 16)].tolist(), lcp[lo : lo + (1 << 16)].tolist())
        for i, (place, common) in enumerate(some, lo):
            while places[-1] > place:
                # the nearest to the right is the present one, the nearest to the left the one below
                j, below = number.pop(), shared.pop()
                places.pop()
                best[j], source[j] = (common, place) if common > below else (below, places[-1])
                common = min(common, below)
            number.append(i)
            places.append(place)
            shared.append(common)
    while number[-1] >= 0:
        j, below = number.pop(), shared.pop()
        places.pop()
        best[j], source[j] = below, places[-1]
    longest[array] = np.frombuffer(best, np.int64)
    where[array] = np.frombuffer(source, np.int64)
    where[longest == 0] = 0
    return longest, where


def lz_blocks(longest: np.ndarray) -> np.ndarray:
    """Starts of the blocks: each is as long as the longest previous factor where it starts, or one word."""
    step, at, out = memoryview(np.maximum(longest, 1)), 0, packed("q")
    while at < len(step):
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def touching(levels: list[np.ndarray], starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """(start, length, period) of the runs of `least` words or more that touch a block's border; some of them several times and with
    multiples of their period. Candidates are worked on some at a time."""
    border = np.append(starts[1:], n)
    size = np.diff(np.append(starts, n))
    most = np.minimum(size + np.append(size[1:], 0), n // 2)
    out = [np.zeros((0, 3), np.int64)]
    k = min((-(-least // 4)).bit_length() - 1, len(levels) - 1)  # a quarter of `least` words agree on one side
    total, lo = np.cumsum(most), 0
    while lo < len(border):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 19), side="right")))
        many = most[lo:hi]
        b = np.repeat(border[lo:hi], many)
        q = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + 1
        for x, y in ((b, b + q), (b - q, b)):  # a period behind the border, and one before it
            ok = (x >= 0) & (y <= n)
            u, v, p = x[ok], y[ok], q[ok]
            # words p apart agree for this many words or more, and so half as many on one side of the border
            need = np.maximum(p, least - p)
            ahead = (levels[k][u] == levels[k][np.minimum(v, n)]) & (v < n)
            back, other = u - (1 << k), v - (1 << k)
            ahead |= (levels[k][np.maximum(back, 0)] == levels[k][np.maximum(other, 0)]) & (back >= 0)
            u, v, p, need = u[ahead], v[ahead], p[ahead], need[ahead]
            f, r = forwards(levels, u, v), backwards(levels, u - 1, v - 1)
            ok = f + r >= need
            out.append(np.column_stack([(u - r)[ok], (f + r + p)[ok], p[ok]]))
        lo = hi
    return np.concatenate(out)


def copied(found: dict[tuple[int, int], int], starts: np.ndarray, longest: np.ndarray, where: np.ndarray, least: int) -> None:
    """Adds to found ((start, length): period) the runs strictly within blocks, from left to right."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (start, length), period in found.items():
        buckets.setdefault(start, []).append((length, period))
    filled = sorted(buckets)
    size = longest[starts]
    for k in np.flatnonzero(size >= least + 2).tolist():
        block, source, n = int(starts[k]), int(where[starts[k]]), int(size[k])
        at = bisect_left(filled, source + 1)
        while at < len(filled) and filled[at] + least < source + n:
            start = filled[at]
            to = start + block - source
            for length, period in list(buckets[start]):
                if start + length < source + n and (to, length) not in found:
                    found[to, length] = period
                    if to not in buckets:
                        buckets[to] = []
                        insort(filled, to)  # to the right of `at`: a source that overlaps its copy yields it, too
                    buckets[to].append((length, period))
            at += 1


def runs(names: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of all runs of `least` words or more, by start, then period. names: as in doublings."""
    n = len(names)
    if n < least:
        return np.zeros((0, 3), np.int64)
    rank, levels = doublings(names)
    if not levels:
        return np.zeros((0, 3), np.int64)
    longest, where = previous_factors(rank, levels)
    starts = lz_blocks(longest)
    found: dict[tuple[int, int], int] = {}
    for start, length, period in touching(levels, starts, n, least).tolist():
        if found.get((start, length), n) > period:  # the smallest of the periods of one stretch is its own
            found[start, length] = period
    if found:
        copied(found, starts, longest, where, least)
    out = np.array([(s, size, p) for (s, size), p in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows with texts of SLICE bytes together, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, lo = np.cumsum(size + 1), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def find_runs(
    docs: DataFrame,
    keep: list[str] | None = None,
    min_words: int = 12,
    text_col: str = "text",
    out_col: str = "repetition",
) -> DataFrame:
    """The rows of docs with their columns `keep` (None: all) and a struct out_col: n_words; runs (start and length in words, period; by
    start, then period) of min_words words or more; collapsed: the words joined by one space, without those
    that stand in a run behind its first period.

    Words stand between ASCII white space. One scan without a shuffle. A null text has no words, no runs and an empty
    collapsed text; repeated rows each come back; an empty table gives no row; a column named like out_col is replaced.
    """
    if min_words < 2:
        raise ValueError("a run has two words at least")
    prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    # kept columns travel in one, so that their names meet no other
    own = F.struct(F.lit(0).alias(fresh(keep, "none")[0]), *[F.col(f"`{c}`") for c in keep]).alias("own")
    source = docs.select(own, F.col(f"`{text_col}`").cast("string").alias("text"))
    found_type = T._parse_datatype_string(f"struct<n_words:bigint,runs:{RUN},collapsed:string>")
    schema = T.StructType([source.schema["own"], T.StructField("found", found_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                words, size = cut(batch.column(1))
                end = np.cumsum(size)
                first = end - size
                owner = np.repeat(np.arange(len(size)), size)
                coded = words.dictionary_encode()
                names = owner * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy()
                all_runs = runs(names, min_words)
                of = np.searchsorted(end, all_runs[:, 0], side="right")
                change = np.zeros(len(names) + 1, np.int64)
                np.add.at(change, all_runs[:, 0] + all_runs[:, 2], 1)
                np.add.at(change, all_runs[:, 0] + all_runs[:, 1], -1)
                stay = np.cumsum(change[:-1]) == 0
                left = np.bincount(owner[stay], minlength=len(size))
                kept = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(left)), pa.int32()), words.filter(pa.array(stay))
                )
                cuts = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(size)))), pa.int32())
                fields = [all_runs[:, 0] - first[of], all_runs[:, 1], all_runs[:, 2]]
                listed = pa.ListArray.from_arrays(
                    cuts, pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["start", "length", "period"])
                )
                found = pa.StructArray.from_arrays(
                    [pa.array(size.astype(np.int64)), listed, pc.binary_join(kept, " ")], names=["n_words", "runs", "collapsed"]
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["own", "found"])

    return source.mapInArrow(run, schema).select(
        *[F.col("own").getField(c).alias(c) for c in keep], F.col("found").alias(out_col)
    )


def longest(runs_col: F.Column) -> F.Column:
    """The run with the greatest length (ties: the smallest start, then period); null if there is none."""
    by = F.transform(runs_col, lambda r: F.struct((-r.length).alias("less"), r.start, r.length, r.period))
    return F.array_min(by)
