"""Markdown reports from ordered DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_ROWS = 250


def escape(value: Column) -> Column:
    """One line, with pipes escaped; a hyphen for null."""
    text = F.replace(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(text, F.lit("-"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """One row (markdown, shown, total): a table of the first `most` rows by `order`, which is unique. Only these meet in a row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[escape(F.col(c)) for c in columns]), F.lit(" |"))
    top = rows.orderBy(*order).limit(most).select(F.struct(*order, line.alias("_line")).alias("r"))
    body = top.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["_line"]), "\n").alias("body"),
        F.count("*").alias("shown"),
    )
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    total = rows.agg(F.count("*").alias("total"))
    # one row each
    return body.join(F.broadcast(total), F.lit(True)).select(
        F.concat(F.lit(head), "body").alias("markdown"), "shown", "total"
    )


def render(title: str, sections: list[tuple[str, DataFrame]]) -> tuple[str, str]:
    """A document of sections (heading, what markdown_table gives) and its SHA-256. Collects one bounded row for each section."""
    import hashlib

    parts = [f"# {title}\n"]
    for heading, table in sections:
        r = table.first()
        more = f"\n\n{r.total - r.shown} more rows are not shown." if r.total > r.shown else ""
        parts.append(f"## {heading}\n\n{r.markdown if r.total else 'Nothing was found.'}{more}\n")
    text = "\n".join(parts)
    return text, hashlib.sha256(text.encode()).hexdigest()


# A static report's sections, in order, and those that it can lack.
SECTIONS = (
    "project",
    "package",
    "apk_metadata",
    "jadx",
    "manifest",
    "obfuscation",
    "context",
    "source_evidence",
    "provenance",
    "limitations",
)
OPTIONAL = ("apk_metadata", "jadx", "manifest", "obfuscation", "context", "source_evidence")


def section_states(parts: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """(key, section, place, included, rows) of each section of each project: a section without rows is missing unless every report has it.

    parts: rows (key, ...) of the sections that there are; projects are those of parts["project"].
    """
    projects = parts["project"].select(key).distinct()
    counted = None
    for name, rows in parts.items():
        n = rows.groupBy(key).agg(F.count("*").alias("rows")).select(key, F.lit(name).alias("section"), "rows")
        counted = n if counted is None else counted.unionByName(n)
    every = projects.select(key, F.posexplode(F.array(*[F.lit(s) for s in SECTIONS])).alias("place", "section"))
    met = every.join(counted, [key, "section"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return met.withColumn(
        "included", (F.col("rows") > 0) | ~F.col("section").isin(*OPTIONAL)
    ).select(key, "section", F.col("place").cast("long"), "included", "rows")


def static_report(
    title: str, notice: str, sections: list[tuple[str, DataFrame | None]], runs: list[str], limits: list[str]
) -> tuple[str, str, list[str], list[str]]:
    """A static report as Markdown, its SHA-256, and the headings of the sections that it has and lacks.

    sections: headings with what markdown_table gives, or None where there is no run. The report depends on its input alone: no times,
    no machine. Provenance lists the runs, limitations what is lacking and `limits`.
    """
    import hashlib

    lines = [f"# {title}", "", f"> **Scope notice:** {notice}", ""]
    have, lack = [], []
    for heading, table in sections:
        row = None if table is None else table.first()  # one bounded row
        if row is None or not row.total:
            lack.append(heading)
            continue
        have.append(heading)
        lines += [f"## {heading}", "", row.markdown, ""]
        if row.total > row.shown:
            lines += [f"{row.total - row.shown} more rows are not shown.", ""]
    lines += ["## Provenance", "", *(f"- `{r}`" for r in runs), *([] if runs else ["No runs are recorded."]), ""]
    lines += ["## Limitations", "", *(f"- Not included: {x}" for x in lack), *(f"- {x}" for x in limits), ""]
    text = "\n".join(lines).rstrip() + "\n"
    return text, hashlib.sha256(text.encode()).hexdigest(), have, lack


def variant_kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY and so on; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _outputs(runs: DataFrame) -> DataFrame:
    """run_id and the run's output (JSON text) as a VARIANT, null where it is no JSON."""
    return runs.select("run_id", F.try_parse_json("output").alias("v"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _each(outputs: DataFrame, path: str, name: str) -> DataFrame:
    """A row for each object in the list at `path`, with its place; other elements and what is no list have none."""
    spread = outputs.select("run_id", "v", F.posexplode(_get(F.col("v"), path, "array<variant>")).alias("place", name))
    return spread.where(variant_kind(F.col(name)) == "OBJECT")


def index_metrics(runs: DataFrame) -> DataFrame:
    """Of runs (run_id, output) of the indexer what a report says of the index: a row for each whose output has an object `index`. A count
    that is not there is 0, but for source_file_count, which is null."""
    v = F.col("v")
    count = lambda name: F.coalesce(_get(v, f"$.{name}", "long"), F.lit(0)).alias(name)
    rows = _outputs(runs).where(variant_kind(_get(v, "$.index")) == "OBJECT")
    return rows.select(
        "run_id",
        _get(v, "$.index.id", "string").alias("index_id"),
        _get(v, "$.index.source_root", "string").alias("source_root"),
        _get(v, "$.source_file_count", "long").alias("source_file_count"),
        *[count(n) for n in ("skipped_source_file_count", "oversized_fallback_source_file_count", "source_index_warning_count", "chunk_count", "summary_count")],
        F.coalesce(_get(v, "$.chunk_count", "long"), F.lit(0)).alias("vector_document_count"),
        _get(v, "$.embedding_provider", "string").alias("embedding_provider"),
    )


def index_warnings(runs: DataFrame) -> DataFrame:
    """(run_id, place, warning) of the indexer's warnings; one whose path, reason or detail is no text is left out."""
    rows = _each(_outputs(runs), "$.source_index_warnings", "w")
    fields = [_get(F.col("w"), f"$.{n}") for n in ("path", "reason", "detail")]
    for f in fields:
        rows = rows.where(variant_kind(f) == "STRING")
    path, reason, detail = (f.cast("string") for f in fields)
    return rows.select("run_id", "place", F.concat(path, F.lit(" ("), reason, F.lit("): "), detail).alias("warning"))


def source_references(runs: DataFrame) -> DataFrame:
    """The matches of query runs as references into the sources: (run_id, place, path, start_line, end_line, symbol, chunk_id, summary). One
    whose path is no text or whose lines are no whole numbers is left out."""
    v, m = F.col("v"), F.col("m")
    rows = _each(_outputs(runs), "$.matches", "m").where(variant_kind(_get(m, "$.path")) == "STRING")
    for n in ("start_line", "end_line"):
        rows = rows.where(variant_kind(_get(m, f"$.{n}")) == "BIGINT")
    said = F.coalesce(_get(v, "$.query", "string"), F.lit("context query"))
    score = F.coalesce(_get(m, "$.score", "string"), F.lit("0"))
    return rows.select(
        "run_id",
        "place",
        _get(m, "$.path", "string").alias("path"),
        _get(m, "$.start_line", "long").alias("start_line"),
        _get(m, "$.end_line", "long").alias("end_line"),
        _get(m, "$.symbol", "string").alias("symbol"),
        _get(m, "$.chunk_id", "string").alias("chunk_id"),
        F.concat(F.lit("Retrieved for "), said, F.lit("; hybrid score "), score).alias("summary"),
    )


def section_tables(rows: DataFrame, key: str, columns: list[str], order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """(key, markdown, shown, total): for each key a table of its first `most` rows by `order`, which is unique within a key.

    No task orders all rows of a key: each of 64 parts of it keeps its first ones, and only `most` of these meet in a row.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[escape(F.col(c)) for c in columns]), F.lit(" |"))
    thin = rows.select(key, *dict.fromkeys(order), line.alias("_line")).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = thin.withColumn("_n", nth(key, "_part")).where(F.col("_n") <= most)
    first = first.withColumn("_n", nth(key)).where(F.col("_n") <= most).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("r")
    )
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    body = F.array_join(F.transform("r", lambda x: x["_line"]), "\n")
    return first.join(total, key).select(key, F.concat(F.lit(head), body).alias("markdown"), F.size("r").cast("long").alias("shown"), "total")


def project_reports(
    projects: DataFrame, notice: str, sections: dict[str, DataFrame], provenance: DataFrame, limits: list[str], key: str = "project_id"
) -> DataFrame:
    """(key, text, sha256, missing): the static report of each project (key, title), assembled by Spark.

    sections: what section_tables gives, by its name in SECTIONS, in that order; one that a project lacks is named among the limitations.
    provenance: what section_tables gives for the runs. A project has one bounded row a section, so a report is one, too.
    """
    asked = [s for s in SECTIONS if s in sections]
    found = None
    for place, name in enumerate([*asked, "provenance"]):
        rows = (sections | {"provenance": provenance})[name].withColumn("place", F.lit(place))
        found = rows if found is None else found.unionByName(rows)
    heads = F.array(*[F.lit(s.replace("_", " ").title()) for s in [*asked, "provenance"]])
    more = F.when(
        F.col("total") > F.col("shown"), F.concat((F.col("total") - F.col("shown")).cast("string"), F.lit(" more rows are not shown.\n\n"))
    ).otherwise(F.lit(""))
    text = F.concat(F.lit("## "), F.get(heads, F.col("place")), F.lit("\n\n"), "markdown", F.lit("\n\n"), more)
    parts = found.select(key, F.struct("place", text.alias("text")).alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    met = projects.select(key, "title").join(parts, key, "left")
    have = F.transform(F.coalesce("parts", F.array().cast("array<struct<place:int,text:string>>")), lambda p: p.place)
    lacking = F.filter(F.sequence(F.lit(0), F.lit(len(asked) - 1)), lambda i: ~F.array_contains(have, i)) if asked else F.array().cast("array<int>")
    none = F.when(F.array_contains(have, len(asked)), F.lit("")).otherwise(F.lit("## Provenance\n\nNo runs are recorded.\n\n"))
    told = met.withColumn("missing", F.transform(lacking, lambda i: F.get(heads, i)))
    bullets = F.concat(F.transform("missing", lambda m: F.concat(F.lit("- Not included: "), m)), F.array(*[F.lit(f"- {x}") for x in limits]).cast("array<string>"))
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<place:int,text:string>>")), lambda p: p.text), "")
    text = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("-")), F.lit(f"\n\n> **Scope notice:** {notice}\n\n"), body, none,
        F.lit("## Limitations\n\n"), F.array_join(bullets, "\n"), F.lit("\n"),
    )
    return told.select(key, text.alias("text"), F.sha2(text, 256).alias("sha256"), "missing")


def benchmark_json(metrics: DataFrame) -> DataFrame:
    """(json): each row as JSON with sorted names, closed by a line feed."""
    return metrics.select(
        F.concat(
            F.to_json(F.struct(*[F.col(c) for c in sorted(metrics.columns)]), {"ignoreNullFields": "false"}),
            F.lit("\n"),
        ).alias("json")
    )
