"""Inventories of packages whose entries share names."""

import random

from pyspark.sql import functions as F

from quarrylight.operators import inventory


def test_entries_of_one_name(spark):
    """`all` takes the size of the first entry by the given column that has one, however the rows lie."""
    rows = [("p", "classes2.dex", None, "x", 0), ("p", "classes2.dex", 7, "x", 1), ("p", "classes2.dex", 3, "x", 2)]
    rows += [("p", f"assets/{i % 10}", 1000 - i, "x", i) for i in range(3, 200)] + [("q", "lib/a/b.so", None, "x", 500)]
    schema = "package string, name string, size long, sha256 string, n long"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        members = spark.createDataFrame(rows, schema).repartition(1 + seed)
        got = inventory.category_totals(members, "n").where("category = 'all'")
        assert {tuple(r) for r in got.select("package", "entries", "bytes").collect()} == {
            ("p", 11, 7 + sum(1000 - i for i in range(3, 13))), ("q", 1, None)
        }
        least = inventory.category_totals(members).where((F.col("category") == "all") & (F.col("package") == "p")).first()
        assert least.bytes == 3 + sum(1000 - i for i in range(190, 200))
