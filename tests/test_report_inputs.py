"""What a report takes from outputs of runs, whatever these hold; tables and reports of many projects."""

from pyspark.sql import functions as F

from quarrylight.operators import report


def test_outputs_with_wrong_types(spark):
    rows = [
        (1, '{"index":{"id":"i","source_root":"r"},"chunk_count":7,"source_index_warnings":[{"path":"p","reason":"x","detail":"d"},{"path":2,"reason":"x","detail":"d"},"w",null]}'),
        (2, '{"index":"text"}'), (3, "broken"), (4, None), (5, "[]"), (6, '{"index":{},"source_index_warnings":{"path":"p"}}'),
        (7, '{"query":5,"matches":[{"path":"p","start_line":1,"end_line":2,"score":0.25},{"path":"p","start_line":"1","end_line":2},{"path":"p","start_line":1.5,"end_line":2},{"start_line":1,"end_line":2},3]}'),
    ]
    runs = spark.createDataFrame(rows, "run_id int, output string")
    got = {r.run_id: (r.index_id, r.source_root, r.source_file_count, r.chunk_count, r.vector_document_count) for r in report.index_metrics(runs).collect()}
    assert got == {1: ("i", "r", None, 7, 7), 6: (None, None, None, 0, 0)}
    assert [(r.run_id, r.warning) for r in report.index_warnings(runs).collect()] == [(1, "p (x): d")]
    found = report.source_references(runs).collect()
    assert [(r.run_id, r.place, r.path, r.start_line, r.end_line, r.symbol, r.summary) for r in found] == [(7, 0, "p", 1, 2, None, "Retrieved for 5; hybrid score 0.25")]
    assert not report.source_references(runs.limit(0)).collect()


def test_reports_of_projects(spark):
    """A hot project's table is cut, one without rows says so, nothing depends on partitions."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4990, 1).otherwise(2).alias("project_id"), "id", F.concat(F.lit("a|"), F.col("id")).alias("v"))
    projects = spark.createDataFrame([(1, "One"), (2, "Two"), (3, None)], "project_id int, title string")
    texts = []
    for n in (1, 7):
        t = report.section_tables(rows.repartition(n), "project_id", ["id", "v"], ["id"], most=3)
        assert {(r.project_id, r.shown, r.total) for r in t.collect()} == {(1, 3, 4990), (2, 3, 10)}
        got = report.project_reports(projects, "n", {"package": t, "context": t.where("project_id = 1")}, t.where("project_id = 2"), ["x"])
        texts.append({r.project_id: (r.text, list(r.missing)) for r in got.collect()})
    assert texts[0] == texts[1]
    assert texts[0][1][0] == (
        "# One\n\n> **Scope notice:** n\n\n## Package\n\n| id | v |\n|---|---|\n| 0 | a\\|0 |\n| 1 | a\\|1 |\n| 2 | a\\|2 |\n\n4987 more rows are not shown.\n\n"
        "## Context\n\n| id | v |\n|---|---|\n| 0 | a\\|0 |\n| 1 | a\\|1 |\n| 2 | a\\|2 |\n\n4987 more rows are not shown.\n\n"
        "## Provenance\n\nNo runs are recorded.\n\n## Limitations\n\n- x\n"
    )
    assert texts[0][3] == ("# -\n\n> **Scope notice:** n\n\n## Provenance\n\nNo runs are recorded.\n\n## Limitations\n\n- Not included: Package\n- Not included: Context\n- x\n", ["Package", "Context"])
