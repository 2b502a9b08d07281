"""Corpus signals: short names, reflection, encoded strings, control flow; how obfuscated a corpus looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Patterns that the signals count.
CLASS_NAME = r"\b(?:class|interface|enum|object)\s+([A-Za-z_$][\w$]*)"
METHOD_NAME = r"(?m)(?:\b(?:public|private|protected|internal|static|final|synchronized|native|abstract)\s+)*(?:fun\s+|[\w$<>\[\],.?]+\s+)([A-Za-z_$][\w$]*)\s*\("
SMALI_CLASS = r"(?m)^\.class\b.*?L(?:.*/)?([^/;]+);"
SMALI_METHOD = r"(?m)^\.method\b.*?\s([\w$<>]+)\("
REFLECTION = r"Class\.forName|getDeclaredMethod|getDeclaredField|java\.lang\.reflect|\.invoke\s*\("
BASE64_STRING = r'"[A-Za-z0-9+/]{32,}={0,2}"'
HEX_STRING = r'"(?:[0-9a-fA-F]{2}){16,}"'
CONTROL_FLOW = r"\b(?:switch|tableswitch|lookupswitch|goto)\b"
CONSTRUCTORS = ["<init>", "<clinit>"]
# Products and the word that names each.
PRODUCTS = {"DexGuard": "dexguard", "Allatori": "allatori", "StringFog": "stringfog"}


def file_signals(files: DataFrame, language: Column | None = None) -> DataFrame:
    """Adds identifiers, reflection, encoded, control and lines to files (content). language: smali has patterns of its own."""
    content = F.coalesce(F.col("content"), F.lit(""))
    names = lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(1))
    brace = F.concat(names(CLASS_NAME), names(METHOD_NAME))
    found = brace if language is None else F.when(
        language == "smali", F.concat(names(SMALI_CLASS), names(SMALI_METHOD))
    ).otherwise(brace)
    count = lambda p: F.regexp_count(content, F.lit(p)).cast("long")
    return files.withColumns(
        {
            "identifiers": F.filter(found, lambda x: ~x.isin(CONSTRUCTORS)),
            "reflection": count(REFLECTION),
            "encoded": count(BASE64_STRING) + count(HEX_STRING),
            "control": count(CONTROL_FLOW),
            "lines": (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        }
    )


def totals(signals: DataFrame, key: str | None = None) -> DataFrame:
    """Sums over files, of each key if there is one."""
    short = F.size(F.filter("identifiers", lambda x: F.length(x) <= 2))
    return signals.groupBy(*([key] if key else [])).agg(
        F.count("*").alias("files"),
        F.sum(F.size("identifiers")).cast("long").alias("names"),
        F.sum(short).cast("long").alias("short_names"),
        *[F.sum(c).cast("long").alias(c) for c in ("reflection", "encoded", "control", "lines")]
    )


def scores(summed: DataFrame) -> DataFrame:
    """Adds the four scores, each from 0 to 1."""
    part = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    files = F.greatest(F.col("files"), F.lit(1)).cast("double")
    density = F.col("control") / F.greatest(F.col("lines") / 1000.0, F.lit(1.0))
    ratio = F.when(F.col("names") > 0, F.col("short_names") / F.col("names")).otherwise(F.lit(0.0))
    return summed.withColumns(
        {
            "name_score": F.when(F.col("names") >= 20, part((ratio - 0.2) / 0.6)).otherwise(F.lit(0.0)),
            "reflection_score": part(F.col("reflection") / files / 2),
            "string_score": part(F.col("encoded") / files / 3),
            "control_score": part((density - 8) / 40),
        }
    )


def classify(scored: DataFrame, has_marker: Column | None = None) -> DataFrame:
    """Adds kind and confidence. Strong is 0.55 and more; a product marker makes 0.9 the least confidence."""
    active = {
        "name-obfuscation": F.col("name_score"),
        "string-obfuscation": F.col("string_score"),
        "control-flow-obfuscation": F.col("control_score"),
    }
    best = F.greatest(*active.values())
    strong = sum(((s >= 0.55).cast("int") for s in active.values()), F.lit(0))
    single = F.lit("none-detected")
    for name, s in reversed(active.items()):
        single = F.when((s == best) & (s >= 0.55), name).otherwise(single)
    kind = F.when(
        (strong > 1) | ((F.col("reflection_score") >= 0.65) & (strong > 0)), "mixed-or-custom"
    ).otherwise(single)
    confidence = F.when(strong > 0, best).otherwise(F.least(F.lit(0.95), 1 - best))
    if has_marker is not None:
        confidence = F.when(has_marker, F.greatest(confidence, F.lit(0.9))).otherwise(confidence)
        kind = F.when(has_marker & (kind == "none-detected"), "mixed-or-custom").otherwise(kind)
    return scored.withColumns({"kind": kind, "confidence": F.round(confidence, 4)})


def product_markers(files: DataFrame, products: dict[str, str] = PRODUCTS, text_col: str = "content") -> DataFrame:
    """(product, path, line) of each line that holds a product's marker, without regard to case. A line is cut only in files with one."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    marks = {p: m.lower() for p, m in products.items()}
    some = F.lit(False)
    for m in marks.values():
        some = some | F.contains(text, F.lit(m))
    cut = files.select("path", text.alias("_t"), some.alias("_some")).where("_some").select("path", F.posexplode(F.split("_t", "\n")).alias("i", "l"))
    held = F.array_compact(F.array(*[F.when(F.contains("l", F.lit(m)), F.lit(p)) for p, m in marks.items()]))
    return cut.select(F.explode(held).alias("product"), "path", (F.col("i") + 1).cast("long").alias("line"))


def marker_locators(marks: DataFrame, most: int = 20) -> DataFrame:
    """(product, files, locators): how many files have a product's marker, and the first `most` of their paths. No task orders all files of
    a product: each of 64 parts keeps its first ones."""
    paths = marks.select("product", "path").distinct().withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(64)))
    files = paths.groupBy("product").agg(F.count("*").alias("files"))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    first = paths.withColumn("_n", nth("product", "_part")).where(F.col("_n") <= most)
    first = first.withColumn("_n", nth("product")).where(F.col("_n") <= most)
    told = first.groupBy("product").agg(F.array_sort(F.collect_list("path")).alias("locators"))
    return files.join(told, "product")


def name_entropy(signals: DataFrame, key: str) -> DataFrame:
    """Shannon entropy (bits) of each key's identifier characters: counts of characters, never their concatenation."""
    chars = signals.select(key, F.explode("identifiers").alias("n")).select(
        key, F.explode(F.split("n", "")).alias("c")
    ).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))
    total = chars.groupBy(key).agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return chars.join(total, key).groupBy(key).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))
