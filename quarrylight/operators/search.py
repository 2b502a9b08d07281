"""Exact and regular-expression search over chunks: counts, matching lines, excerpts, bounded ranking."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylight.functions.text import lines, occurrences, regex_occurrences
from quarrylight.session import for_workers, shared_folder


def line_matches(content: Column, start_line: Column, hit, most: int = 200) -> Column:
    """Absolute numbers of the lines for which `hit` (of a line's text) holds; the first `most` of them."""
    numbered = F.transform(lines(content), lambda x, i: F.when(hit(x), (start_line + i).cast("int")))
    return F.slice(F.array_compact(numbered), 1, most)


#: Keys, or pairs of rows, up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def search(
    chunks: DataFrame, query: str, regex: bool = False, ignore_case: bool = True, most_lines: int = 200
) -> DataFrame:
    """Chunks with a match: match_count, distinct_match_line_count, match_lines, match_lines_truncated. One scan without a shuffle; ids
    are a corpus's own, each there once (first_places keeps one row of each where they are not)."""
    if not 1 <= most_lines <= 10_000:
        raise ValueError("1 to 10000 lines")
    count = (
        lambda c: regex_occurrences(c, query, ignore_case)
    ) if regex else (lambda c: occurrences(c, query, ignore_case))
    found = chunks.withColumn("match_count", count(F.col("content"))).where("match_count > 0")
    every = line_matches(F.col("content"), F.col("start_line"), lambda x: count(x) > 0, 2**31 - 1)
    return found.withColumn("_lines", every).withColumns(
        {
            "distinct_match_line_count": F.size("_lines").cast("long"),
            "match_lines": F.slice("_lines", 1, most_lines),
            "match_lines_truncated": F.size("_lines") > most_lines,
        }
    ).drop("_lines")


def first_places(chunks: DataFrame) -> DataFrame:
    """Of repeated ids the first place. Only ids and places are ordered; texts are joined back by a hash of theirs."""
    order = Window.partitionBy("id").orderBy("path", "start_line", "_hash")
    thin = chunks.select("id", "path", "start_line", F.xxhash64("content").alias("_hash"))
    first = thin.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    same = chunks.withColumn("_hash", F.xxhash64("content")).dropDuplicates(["id", "path", "start_line", "_hash"])
    return same.join(first, ["id", "path", "start_line", "_hash"], "left_semi").drop("_hash")


def search_bounded(
    chunks: DataFrame, pattern: str, seconds: float = 1.0, ignore_case: bool = True, most_lines: int = 200
) -> DataFrame:
    """As search with a regular expression, but a chunk takes at most about `seconds`: all chunks with a match, and those where the time
    ran out, with state: found, or timed-out (no counts then).

    The pattern is one of the `regex` library, whose matching checks its time as it goes: a pattern that repeats what repeats is
    allowed, and the chunks on which it explodes are told. Each row with a match comes back; of repeated ids keep one beforehand.
    """
    import regex

    if not 0 < len(pattern) <= 4096:
        raise ValueError("a pattern has 1 to 4096 characters")
    if not 1 <= most_lines <= 10_000 or seconds <= 0:
        raise ValueError("1 to 10000 lines and more than 0 seconds")
    flags = regex.MULTILINE | (regex.IGNORECASE if ignore_case else 0)
    try:
        if regex.compile(pattern, flags).search("", timeout=seconds) is not None:
            raise ValueError("the pattern matches the empty text")
    except regex.error as e:
        raise ValueError(f"no regular expression: {e}") from None
    except TimeoutError:
        raise ValueError("the pattern takes too long on the empty text") from None
    name = "_found"
    while name in chunks.columns:
        name += "_"

    @F.pandas_udf("struct<state:string,n:long,distinct:long,lines:array<int>>")
    def matches(contents: pd.Series, starts: pd.Series) -> pd.DataFrame:
        compiled, rows = regex.compile(pattern, flags), []
        for text, start in zip(contents, starts):
            n, lines, line, at, until = 0, [], start, 0, time.monotonic() + seconds
            distinct, last = 0, None
            try:
                for m in compiled.finditer(text, timeout=seconds):
                    n += 1
                    line += text.count("\n", at, m.start())
                    at = m.start()
                    if line != last:
                        distinct, last = distinct + 1, line
                        if len(lines) < most_lines:
                            lines.append(int(line))
                    if time.monotonic() > until:
                        raise TimeoutError
                rows.append(("found" if n else None, n, distinct, lines))
            except TimeoutError:
                rows.append(("timed-out", None, None, None))
        return pd.DataFrame(rows, columns=["state", "n", "distinct", "lines"]).astype({"n": "Int64", "distinct": "Int64"})

    for_workers(chunks.sparkSession)
    start = F.coalesce(F.col("start_line").cast("int"), F.lit(1))
    told = chunks.withColumn(name, matches(F.coalesce("content", F.lit("")), start)).where(F.col(name).state.isNotNull())
    return told.withColumns(
        {
            "state": F.col(name).state,
            "match_count": F.col(name).n,
            "distinct_match_line_count": F.col(name).distinct,
            "match_lines": F.col(name).lines,
            "match_lines_truncated": F.col(name).distinct > F.size(F.col(name).lines),
        }
    ).drop(name)


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """Most matches first, then by path without regard to case, place and id. A bounded heap in each task, not a full sort."""
    if k < 1:
        raise ValueError("one hit at least")
    return hits.orderBy(F.desc("match_count"), F.lower("path"), "start_line", "id").limit(k)


def excerpt(hits: DataFrame, phrase: str, context_lines: int = 2, most_chars: int = 1200) -> DataFrame:
    """Adds excerpt, excerpt_start_line and excerpt_end_line: the lines around the first match.

    Longer ones are clipped to most_chars, ellipses included, with about a third of these before the match.
    """
    if context_lines < 0 or most_chars < 16:
        raise ValueError("context_lines is 0 or more, most_chars 16 or more")
    at = F.locate(phrase.lower(), F.lower("content"))  # the first match, from 1
    before = F.substring(F.col("content"), F.lit(1), at - 1)
    hits = hits.withColumn("_cut", lines(F.col("content"))).withColumn(
        "_at", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    )
    hits = hits.withColumn("_first", F.greatest(F.lit(1), F.col("_at") - context_lines)).withColumn(
        "_last", F.least(F.size("_cut"), F.col("_at") + context_lines)
    )
    skipped = F.when(
        F.col("_first") > 1, F.length(F.array_join(F.slice("_cut", 1, F.col("_first") - 1), "\n")) + 1
    ).otherwise(F.lit(0))
    hits = hits.withColumn(
        "_raw", F.array_join(F.slice("_cut", F.col("_first"), F.col("_last") - F.col("_first") + 1), "\n")
    ).withColumn("_rel", at - 1 - skipped)
    clip = F.when(
        F.length("_raw") > most_chars,
        F.least(F.greatest(F.lit(0), F.col("_rel") - most_chars // 3), F.length("_raw") - most_chars),
    ).otherwise(F.lit(0))
    hits = hits.withColumn("_clip", clip)
    front = F.when(F.col("_clip") > 0, F.lit("…")).otherwise(F.lit(""))
    behind = F.when(F.col("_clip") + most_chars < F.length("_raw"), F.lit("…")).otherwise(F.lit(""))
    kept = F.when(
        F.length("_raw") > most_chars,
        F.substring(F.col("_raw"), F.col("_clip") + 1, F.lit(most_chars) - F.length(front) - F.length(behind)),
    ).otherwise(F.col("_raw"))
    hits = hits.withColumn("_kept", kept)
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    start = F.col("start_line") + F.col("_first") - 1 + feeds(F.substring(F.col("_raw"), F.lit(1), F.col("_clip")))
    end = start + feeds(F.col("_kept")) - F.when(F.endswith(F.col("_kept"), F.lit("\n")), 1).otherwise(0)
    return hits.withColumns(
        {
            "excerpt": F.when(
                F.length("_raw") > most_chars, F.concat(front, F.col("_kept"), behind)
            ).otherwise(F.col("_raw")),
            "excerpt_start_line": start.cast("int"),
            "excerpt_end_line": F.greatest(start, end).cast("int"),
        }
    ).drop("_cut", "_at", "_first", "_last", "_raw", "_rel", "_clip", "_kept")


def path_prefixes(chunks: DataFrame, prefixes: list[str]) -> DataFrame:
    """Chunks whose path begins with one of at most 64 prefixes, taken literally."""
    if not 0 < len(prefixes) <= 64:
        raise ValueError("1 to 64 prefixes")
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col("path"), F.lit(p))
    return chunks.where(hit)


def by_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ids (a table with that column)."""
    return rows.join(ids.select(column), column, "left_semi")


def containing(texts: DataFrame, phrases: DataFrame, text_col: str, phrase_col: str, words: int = 6) -> DataFrame:
    """texts beside each row of phrases whose phrase they contain, each pair of rows once; column names of both sides differ.

    The words of a phrase but its first and last stand in such a text as whole words, so up to `words` of them, hashed together, are
    a key that both have; `contains` decides. Phrases of fewer than three words have no such key and are looked for in every text:
    at most 10000 of these are allowed. Null and empty phrases are in no text.
    """
    spark = texts.sparkSession
    cut = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    row = lambda df: F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.md5(F.concat_ws("\0", *[F.col(f"`{c}`").cast("string") for c in df.columns])))
    asked = phrases.where(F.length(phrase_col) > 0).withColumn(
        "_w", F.filter(F.split(F.col(phrase_col), r"\s+"), lambda w, i: i > 0)
    )
    asked = asked.withColumn(
        "_w", F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0)))
    ).withColumn("_n", F.least(F.size("_w"), F.lit(words)))
    long = asked.where("_n > 0").withColumn("_key", F.xxhash64("_n", F.transform(F.slice("_w", 1, F.col("_n")), lambda w: F.xxhash64(w))))
    wanted = long.select("_key").distinct()
    lengths = sorted(r["_n"] for r in long.select("_n").distinct().collect())  # at most `words`
    out = None
    if lengths:
        hashed = texts.select(row(texts).alias("_row"), F.transform(cut(text_col), lambda w: F.xxhash64(w)).alias("_h"))
        windows = lambda n: F.when(
            F.size("_h") >= n,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("_h") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.slice("_h", i, n))),
        ).otherwise(F.array().cast("array<bigint>"))
        keys = F.array_distinct(F.concat(*[windows(n) for n in lengths]))
        # what is spread is a row's hash and a key; texts themselves are met again by the few rows with a wanted key
        spread = hashed.select("_row", F.explode(keys).alias("_key"))
        met = spread.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "_key")
        path = shared_folder(spark, "containing")
        met.join(long.select("_key", row(phrases).alias("_phrase")).distinct(), "_key").select("_row", "_phrase").distinct().write.parquet(path)
        pairs = spark.read.parquet(path)
        small = pairs.count() <= BROADCAST_KEYS
        named = texts.withColumn("_row", row(texts)).join(F.broadcast(pairs) if small else pairs, "_row")
        told = phrases.withColumn("_phrase", row(phrases)).where(F.length(phrase_col) > 0)
        out = named.join(told, "_phrase").where(F.contains(F.col(text_col), F.col(phrase_col))).select(*texts.columns, *phrases.columns)
    short = asked.where("_n = 0").drop("_w", "_n")
    n_short = short.limit(10_001).count()
    if n_short > 10_000:
        raise ValueError("over 10000 phrases of fewer than three words")
    if n_short or out is None:
        met = texts.join(F.broadcast(short), F.contains(F.col(text_col), F.col(phrase_col)))  # their number is checked
        out = met if out is None else out.unionByName(met)
    return out
