"""Hybrid ranking and greedy packing of ranked chunks under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.session import for_workers


def candidate_budget(total: int, limit: int) -> int:
    """How many semantic candidates a query of `limit` results looks at."""
    return min(total, max(limit, min(2000, max(100, 5 * limit))))


def hybrid_score(lexical: Column, semantic: Column, location: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * lexical + 0.45 * semantic + 0.05 * location)


def rank_hybrid(candidates: DataFrame, limit: int) -> DataFrame:
    """candidates (id, path, start_line, lexical_score, semantic_score, location_boost): those with a score, best first."""
    scored = candidates.withColumn(
        "score", hybrid_score(F.col("lexical_score"), F.coalesce("semantic_score", F.lit(0.0)), F.col("location_boost"))
    ).where("score <> 0")
    return scored.withColumn("score", F.round("score", 6)).orderBy(
        F.desc("score"), "path", "start_line", "id"
    ).limit(limit)


def pack_budget(ranked: DataFrame, budget: int, key: str = "query_id", overhead: int = 0) -> DataFrame:
    """Greedy packing of each key's candidates (rank, id, source_bytes, summary_bytes or null) into `budget` tokens.

    In order of rank a candidate's source is taken if it fits, else its summary, else it is left out and the next one is
    tried. Tokens are a quarter of the bytes of all taken texts and of the two line feeds between them, rounded
    up, and `overhead` for each. Candidates that no empty budget holds are left out first; the others pass a task in order, a few
    numbers for the key at hand being all that it keeps. Returns (key, rank, id, representation, estimated_tokens).
    """
    if budget < 0 or overhead < 0:
        raise ValueError("budget and overhead are 0 or more")
    for_workers(ranked.sparkSession)
    rows = ranked.select(
        key,
        F.col("rank").cast("long").alias("rank"),
        F.col("id").cast("string").alias("id"),
        F.col("source_bytes").cast("long").alias("s"),
        F.col("summary_bytes").cast("long").alias("m"),
    )
    alone = F.floor((F.least("s", "m") + 3) / 4) + overhead  # least skips nulls
    dealt = rows.where(alone <= budget).repartition(key).sortWithinPartitions(key, "rank", "id")
    kind = dealt.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, used, n = object(), 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for k, rank, name, source, summary in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k != at:
                    at, size, used, n = k, 0, 0, 0
                for how, more in (("source", source), ("summary", summary)):
                    if more is None:
                        continue
                    whole = size + more + (2 if n else 0)
                    cost = (whole + 3) // 4 + overhead * (n + 1)
                    if cost <= budget:
                        out.append((k, rank, name, how, cost - used))
                        size, used, n = whole, cost, n + 1
                        break
            names = (key, "rank", "id", "representation", "estimated_tokens")
            kinds = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else ([],) * 5, kinds)], names=list(names)
            )

    return dealt.mapInArrow(fold, f"`{key}` {kind}, rank long, id string, representation string, estimated_tokens long")
