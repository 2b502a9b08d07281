"""Cross-site boilerplate: lines that spread over many distinct sites go.

One aggregation of all lines by their hash merges HyperLogLog sketches of their sites, first within tasks, then between
them: a hot line or site leaves a task as one sketch. Where a sketch's estimate lies too near the threshold to decide, the
line's distinct sites are counted exactly. The hashes of the lines that go travel to the texts in blocks of bounded
size; texts pass all blocks, one after the other, in one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylight.llm.common import alone, fresh, map_in_arrow, prepare, written

#: Relative standard error of a sketch with 2**k registers is about this over the square root of 2**k.
ERROR = 1.04
SPACE, SEED = " \t\n\x0b\f\r", 42


def _lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: F.Column) -> F.Column:
    """Of a line without the ASCII white space around it; of its UTF-8 bytes."""
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def _counts(line: F.Column, min_words: int) -> F.Column:
    """Has at least min_words words between ASCII white space."""
    return F.regexp_like(line, F.lit("^\\s*" + "\\S+\\s+" * (min_words - 1) + "\\S"))


def boilerplate(
    docs: DataFrame,
    min_sites: int = 8,
    min_words: int = 4,
    lg_k: int = 12,
    sigmas: float = 4.0,
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """(line, sites, exact): hash of each line of at least min_words words on min_sites sites or more.

    sites is the sketch's estimate, or the exact number where exact is true. A null site counts as none, a null text has no
    line that counts; lines equal but for the white space around them are one; repeated rows change nothing. An empty
    table gives no row. Further columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)
    cut = docs.select(
        F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("l")
    ).where("site is not null")
    rows = cut.where(_counts(F.col("l"), min_words)).select(_hash(F.col("l")).alias("line"), "site")
    merged = rows.groupBy("line").agg(
        F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")
    )
    # fewer rows cannot be on so many sites
    sketched = written(merged.where(F.col("n") >= min_sites).select("line", "sites"), "sketches")
    margin = max(1.0, sigmas * ERROR / 2 ** (lg_k / 2) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= margin
    unsure = written(sketched.where(near).select("line"), "unsure")  # so that Spark sees its size
    exact = rows.join(
        unsure, "line", "left_semi"
    ).groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count("*").alias("sites"))
    sure = sketched.where(~near).select("line", F.col("sites").cast("long").alias("sites"), F.lit(False).alias("exact"))
    return sure.union(exact.select("line", "sites", F.lit(True))).where(F.col("sites") >= min_sites)


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 8,
    min_words: int = 4,
    text_col: str = "text",
    site_col: str = "source",
    length_col: str | None = "n_chars",
    counts: bool = False,
    block_lines: int = 2_000_000,
    **options
) -> DataFrame:
    """docs without its boilerplate lines: same rows, same columns, text and length_col (code points, if there) made anew.

    The lines left stay as they are, in their order, joined by line feeds; a text may become empty. Null
    texts stay null. Each occurrence of a line goes, repeated rows and lines included. counts=True adds
    n_lines and n_removed (longs), in place of columns so named. An empty table stays empty. block_lines: how many hashes
    are broadcast at once.
    """
    spark = docs.sparkSession
    spread = written(
        boilerplate(docs, min_sites, min_words, text_col=text_col, site_col=site_col, **options).select("line"),
        "boilerplate",
    )
    blocks = max(1, -(-spread.count() // block_lines))
    (gone,) = fresh([*docs.columns, "n_lines", "n_removed"], "_gone")
    out = docs.withColumn(gone, F.lit(0).cast("long"))
    if counts:
        out = out.withColumn("n_lines", F.size(_lines(F.col(text_col))).cast("long"))
    for block in range(blocks):
        some = spread.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == block).toPandas()["line"]
        sent = spark.sparkContext.broadcast(np.sort(some.to_numpy(np.int64)))
        out = map_in_arrow(
            out,
            _strip(sent, out.columns.index(text_col), out.columns.index(gone), min_words),
            T.StructType(out.schema.fields),
        )
    if length_col in docs.columns:
        out = out.withColumn(
            length_col,
            F.when(
                F.col(gone) == 0, F.col(length_col)
            ).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType),
        )
    if counts:
        out = out.withColumn("n_removed", F.col(gone))
    extra = [c for c in ("n_lines", "n_removed") if counts]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra], *extra)


def _strip(sent, text_at: int, gone_at: int, min_words: int):
    """Takes the lines with these hashes out of the texts and adds how many these were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        drop = sent.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            cut = [None if t is None else t.split(b"\n") for t in texts]
            place, found = [], []
            for i, lines in enumerate(cut):
                for j, line in enumerate(lines or ()):
                    if len(line.split(None, min_words)) >= min_words:
                        place.append((i, j))
                        found.append(xxhash.xxh64_intdigest(line.strip(), SEED))
            hashed = np.array(found, np.uint64).view(np.int64)
            at = np.searchsorted(drop, hashed)
            hit = np.flatnonzero(drop[np.minimum(at, len(drop) - 1)] == hashed) if len(drop) else ()
            gone = np.zeros(len(texts), np.int64)
            for k in hit:
                i, j = place[k]
                cut[i][j] = None
                gone[i] += 1
            for i in np.flatnonzero(gone):
                texts[i] = b"\n".join(x for x in cut[i] if x is not None)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.binary()).cast(batch.column(text_at).type)
            columns[gone_at] = pa.array(gone + batch.column(gone_at).to_numpy())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run
