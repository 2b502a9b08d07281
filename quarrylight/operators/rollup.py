"""Summaries of methods, files, packages and projects from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylight.functions.text import INDICATORS, indicators, lines, parent

# How many names a summary lists.
FILE_SYMBOLS, PACKAGE_FILES, PACKAGE_SYMBOLS, METHOD_CHARS = 20, 15, 25, 240


def first_values(rows: DataFrame, key: str, column: str, most: int, name: str) -> DataFrame:
    """(key, name array, name_count): the least `most` distinct values of each key, and how many there are.

    Distinct values are counted and cut by rank before they meet in a row, so a key with millions of them is no large row.
    """
    values = rows.where(F.col(column).isNotNull()).select(key, F.col(column).alias("_v")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_v"))
    kept = values.withColumn("_n", nth).where(F.col("_n") <= most).groupBy(key).agg(
        F.array_sort(F.collect_list("_v")).alias(name)
    )
    return kept.join(values.groupBy(key).agg(F.count("*").alias(f"{name}_count")), key)


def listed(values: Column, count: Column) -> Column:
    """The values and how many more there are; `none` for no value."""
    more = F.when(
        count > F.size(values), F.concat(F.lit(" (+"), (count - F.size(values)).cast("string"), F.lit(" more)"))
    ).otherwise(F.lit(""))
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit("none")).otherwise(F.concat(F.array_join(values, ", "), more))


def method_summaries(chunks: DataFrame) -> DataFrame:
    """(id, content) of method chunks: what they are, where, how they begin (240 characters at most) and what they show."""
    first = F.get(F.filter(F.transform(lines(F.col("content")), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    begins = F.coalesce(first, F.lit("<empty>"))
    begins = F.when(
        F.length(begins) > METHOD_CHARS, F.concat(F.left(begins, F.lit(METHOD_CHARS - 3)), F.lit("..."))
    ).otherwise(begins)
    shown = indicators(F.col("content"))
    where = F.concat(
        "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")
    )
    names = F.when(F.size(shown) == 0, F.lit("none")).otherwise(F.array_join(shown, ", "))
    text = F.concat(
        F.coalesce("symbol", F.lit("<anonymous>")),
        F.lit(" in "),
        where,
        F.lit("; signature `"),
        begins,
        F.lit("`; indicators: "),
        names,
        F.lit("."),
    )
    return chunks.where("kind = 'method'").select("id", text.alias("content"))


def file_summaries(chunks: DataFrame) -> DataFrame:
    """(path, chunks, methods, symbols, symbols_count, indicators, content). An indicator holds if one of the file's chunks has it."""
    # one pass over the contents: what a symbol's chunks show; then a rank over a file's symbols
    flag = {f"_f{i}": F.max(F.regexp_like("content", F.lit(p)).cast("int")).alias(f"_f{i}") for i, p in enumerate(INDICATORS.values())}
    by_symbol = chunks.groupBy("path", "symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "method").alias("m"), *flag.values()
    )
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.col("symbol").asc_nulls_last()))
    first = F.when(F.col("_nth") <= FILE_SYMBOLS, F.col("symbol"))
    grouped = by_symbol.withColumn("_nth", nth).groupBy("path").agg(
        F.sum("n").alias("chunks"),
        F.sum("m").alias("methods"),
        F.array_compact(F.array(*[F.when(F.max(c) == 1, F.lit(n)) for c, n in zip(flag, INDICATORS)])).alias("indicators"),
        F.array_sort(F.collect_list(first)).alias("symbols"),
        F.count("symbol").alias("symbols_count"),
    )
    text = F.concat(
        "path", F.lit(": "), F.col("chunks").cast("string"), F.lit(" chunks, "), F.col("methods").cast("string"), F.lit(
            " methods. Symbols: "
        ),
        listed(F.col("symbols"), F.col("symbols_count")), F.lit(". Indicators: "), listed(
            F.col("indicators"), F.size("indicators")
        ), F.lit("."),
    )
    return grouped.withColumn("content", text)


def package_summaries(chunks: DataFrame) -> DataFrame:
    """(package, files, chunks, content): packages are the paths' parents."""
    rows = chunks.select(parent(F.col("path")).alias("package"), "path", "symbol")
    grouped = rows.groupBy("package").agg(F.count("*").alias("chunks"))
    for column, most, name in (("path", PACKAGE_FILES, "_paths"), ("symbol", PACKAGE_SYMBOLS, "_symbols")):
        grouped = grouped.join(first_values(rows, "package", column, most, name), "package", "left")
    text = F.concat(
        F.lit("Package "), F.when(
            F.col("package") == "", "<root>"
        ).otherwise(F.col("package")), F.lit(": "), F.col("_paths_count").cast("string"), F.lit(" files, "),
        F.col("chunks").cast("string"), F.lit(" chunks. Files: "), listed(
            F.col("_paths"), F.col("_paths_count")
        ), F.lit(". Symbols: "),
        listed(F.col("_symbols"), F.coalesce("_symbols_count", F.lit(0))), F.lit("."),
    )
    return grouped.select("package", F.col("_paths_count").alias("files"), "chunks", text.alias("content"))


def project_summary(chunks: DataFrame, key: str | None = None) -> DataFrame:
    """(files, chunks, languages), of each key if there is one. Languages are few."""
    names = F.array_join(F.array_sort(F.collect_set("language")), ", ")
    return chunks.groupBy(*([key] if key else [])).agg(
        F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), names.alias("languages")
    )


def summaries(chunks: DataFrame, index_id: str, fingerprint: str) -> DataFrame:
    """(id, index_id, level, scope, source_fingerprint, content) of every method, class (file), package and the project."""
    whole = F.concat(
        F.lit("Project: "),
        F.col("files").cast("string"),
        F.lit(" files, "),
        F.col("chunks").cast("string"),
        F.lit(" chunks. Languages: "),
        F.when(F.col("languages") == "", "none").otherwise(F.col("languages")),
        F.lit("."),
    )
    levels_ = [
        method_summaries(chunks).select(F.lit("method").alias("level"), F.col("id").alias("scope"), "content"),
        file_summaries(chunks).select(F.lit("class").alias("level"), F.col("path").alias("scope"), "content"),
        package_summaries(chunks).select(F.lit("package").alias("level"), F.col("package").alias("scope"), "content"),
        project_summary(chunks).select(
            F.lit("project").alias("level"), F.lit("project").alias("scope"), whole.alias("content")
        ),
    ]
    out = levels_[0]
    for more in levels_[1:]:
        out = out.unionByName(more)
    name = F.concat(
        F.lit("sum_"), F.sha2(F.concat_ws("\0", F.lit(index_id), "level", "scope", F.lit(fingerprint)), 256)
    )
    return out.select(
        name.alias("id"),
        F.lit(index_id).alias("index_id"),
        "level",
        "scope",
        F.lit(fingerprint).alias("source_fingerprint"),
        "content",
    )


def levels(chunks: DataFrame) -> DataFrame:
    """(level, scope, files, chunks) of methods, files, packages and the project together; a method's scope is its path and symbol."""
    with_package = chunks.withColumn("package", parent(F.col("path")))
    # the larger levels read this, not the chunks
    counts = with_package.groupBy("path", "package").agg(F.count("*").alias("n"))
    one = F.lit(1).cast("long").alias("files")
    methods = chunks.where("kind = 'method'").groupBy("path", "symbol").agg(F.count("*").alias("chunks"))
    methods = methods.select(
        F.lit("method").alias("level"),
        F.concat("path", F.lit("#"), F.coalesce("symbol", F.lit("<anonymous>"))).alias("scope"),
        one,
        "chunks",
    )
    files = counts.select(F.lit("class"), F.col("path"), one, F.col("n"))
    packages = counts.groupBy("package").agg(
        F.count("*").alias("files"), F.sum("n").alias("chunks")
    ).select(F.lit("package"), F.col("package"), "files", "chunks")
    project = counts.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
    ).select(F.lit("project"), F.lit("project"), "files", "chunks")
    return methods.union(files).union(packages).union(project)
