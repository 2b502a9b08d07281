"""Tables of run records: upserts, insert if absent, updates, replaced partitions, and a marker that publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylight.operators.lineage import latest


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both, with the latest row of each key; `order` decides, and a change beats a current row that is equal in it."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, F.desc("_new")]).drop("_new")


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not there, each key once."""
    return rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def update(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """current with `columns` from changes, where there is a change; a change without its row is an error."""
    unknown = changes.join(current.select(key), key, "left_anti")
    if unknown.limit(1).count():
        raise ValueError("a change names a row that does not exist")
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = current.join(new, key, "left")
    return out.select(
        *[
            (F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
            for c in current.columns
        ]
    )


def replace_partition(rows: DataFrame, path: str, partition: str) -> None:
    """Puts rows in place of the partitions that they belong to; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def publish(rows: DataFrame, path: str, version: str) -> int:
    """Writes a version of a table, then the marker that makes it the one that readers see. Returns its rows."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/data/{version}")
    n = spark.read.parquet(f"{path}/data/{version}").count()
    spark.createDataFrame(
        [(version, n)], "version string, rows long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/published")
    return n


def published(spark: SparkSession, path: str) -> DataFrame:
    """The published version; an error if its rows are not those that the marker counts."""
    mark = spark.read.parquet(f"{path}/published").first()
    rows = spark.read.parquet(f"{path}/data/{mark.version}")
    if rows.count() != mark.rows:
        raise ValueError(f"version {mark.version} is incomplete")
    return rows
