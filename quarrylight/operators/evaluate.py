"""Retrieval quality: ranks of the first relevant result, hit rates and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedupe_ranks(retrieved: DataFrame, most: int) -> DataFrame:
    """retrieved (case_id, rank, id, ...): each id at its first rank, ranks made gapless, the first `most` kept."""
    first = Window.partitionBy("case_id", "id").orderBy("rank")
    again = Window.partitionBy("case_id").orderBy("rank", "id")
    kept = retrieved.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= most)


def first_relevant(retrieved: DataFrame, cases: DataFrame, relevant: Column) -> DataFrame:
    """Of every case the rank of its first relevant result, or null: (case_id, first_rank, reciprocal_rank)."""
    ranks = retrieved.where(relevant).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("case_id").distinct().join(ranks, "case_id", "left").withColumn(
        "reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))
    )


def relevant(retrieved: DataFrame, cases: DataFrame) -> DataFrame:
    """retrieved (case_id, rank, id, path) as (case_id, first_rank, reciprocal_rank) of every case (case_id, expected_ids, expected_paths):
    a result is relevant if its id or its path is expected."""
    met = retrieved.join(cases, "case_id")
    hit = F.coalesce(F.array_contains("expected_ids", F.col("id")), F.lit(False)) | F.coalesce(
        F.array_contains("expected_paths", F.col("path")), F.lit(False)
    )
    return first_relevant(met, cases, hit)


def metrics(by_case: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One row: cases, hit_at_k and hit_rate_at_k of each cutoff, mrr."""
    if not cutoffs or len(set(cutoffs)) != len(cutoffs) or not all(1 <= k <= 10_000 for k in cutoffs):
        raise ValueError("cutoffs are different numbers from 1 to 10000")
    hits = [F.count_if(F.col("first_rank") <= k).alias(f"hit_at_{k}") for k in sorted(cutoffs)]
    rates = [
        F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_rate_at_{k}")
        for k in sorted(cutoffs)
    ]
    return by_case.agg(F.count("*").alias("cases"), *hits, *rates, F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def regressions(metrics_row: DataFrame, floors: dict[str, float]) -> DataFrame:
    """A row for each metric below its floor: (metric, value, floor)."""
    named = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(f)).alias("floor")
            ) for m,
            f in floors.items()
        ]
    )
    return metrics_row.select(F.explode(named).alias("m")).select("m.*").where("value < floor")
