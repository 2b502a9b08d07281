"""Summaries of odd texts beside their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quarrylight.operators import rollup
from quarrylight.plans.catalogue import QUERIES
from quarrylight.plans.twins import TWINS

TEXTS = [None, "", " ", "\n", "  \n\n  x  \n", "0 a 0", "000", "\n1 b 1\n", "\t a\t\n", "é" * 241, " " * 300 + "y", "87.92.18.40"]
TEXTS += ["encrypté", "中token中", "éJNI", "native٣", "Class.forNamé", "_mac", "toKen", "requeſt", "ſocket", "aſocket"]
TEXTS += ["httpſ", "logın", "LOGİN", "HTTPS:", "Native", "mac\u0085", "a\x00b encrypt"]


def test_odd_texts(spark, tmp_path):
    n = len(TEXTS)
    rows = {"doc_id": pa.array(range(0, 2 * n, 2), pa.int64()), "text": TEXTS, "lang": ["en"] * n, "source": ["s"] * n}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("method_summaries", "summary_file"):
        got = duck.execute(TWINS[name])
        df = QUERIES[name](spark, str(tmp_path)).select([c[0] for c in got.description])
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, got.fetchall()))


def test_first_line_keeps_its_digits(spark):
    c = spark.createDataFrame([("i", "p", "method", "f", 1, 9, "  0x10 \nb")], "id string, path string, kind string, symbol string, start_line int, end_line int, content string")
    assert rollup.method_summaries(c).first().content == "f in p:1-9; signature `0x10`; indicators: none."
