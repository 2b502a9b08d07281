"""The index of a corpus and hybrid queries over it: chunks, vectors, summaries, candidates, ranking, packing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrylight.functions.text import one_line
from quarrylight.operators import chunking, ranking, rollup, snapshots, vectors
from quarrylight.operators.ranking import candidate_budget

MOST_KNOWN = 1000
#: Queries up to which their phrases are broadcast.
BROADCAST_QUERIES = 100_000


@dataclass(frozen=True)
class Provider:
    """Something that gives texts vectors. embed adds a column `vector` of `dimensions` numbers to rows with `content`."""

    name: str
    dimensions: int
    embed: Callable[[DataFrame], DataFrame]


def hashing(dimensions: int = 384) -> Provider:
    return Provider("local-hashing-v1", dimensions, lambda rows: vectors.hash_embedding(rows, dimensions))


def embedded(rows: DataFrame, provider: Provider) -> DataFrame:
    """rows with the provider's vectors; one of another length is an error."""
    right = F.size("vector") == provider.dimensions
    return provider.embed(rows).withColumn(
        "vector",
        F.when(right, F.col("vector")).otherwise(F.raise_error("a vector has another length than its provider says")),
    )


def identity(fingerprint: str, provider: Provider) -> str:
    """The name of a collection of vectors: what it is made of."""
    import hashlib

    return "vec_" + hashlib.sha256(f"{fingerprint}\0{provider.name}\0{provider.dimensions}".encode()).hexdigest()[:24]


def corpus_fingerprint(chunks: DataFrame) -> str:
    """One hash for a corpus: over the sums and the number of its chunk ids' hashes, so that no row gathers all ids."""
    r = chunks.agg(F.count("*"), *[F.sum(F.xxhash64("id", F.lit(s)).cast("decimal(38,0)")) for s in range(4)]).first()
    import hashlib

    return hashlib.sha256(" ".join(map(str, r)).encode()).hexdigest()


def place(path: str, index_id: str) -> str:
    """Where an index's versions lie."""
    from urllib.parse import quote

    return f"{path}/{quote(index_id, safe='')}"


def build(chunks: DataFrame, path: str, index_id: str, provider: Provider) -> dict:
    """Makes a version of an index below path: chunks, vectors and summaries in new folders, published together, last of all.

    A reader of the version before sees all of that until the end and, if it keeps its snapshot, beyond. A failed or killed
    build leaves the index as it was. Vectors are named by what they are made of, chunks and provider: those of the version before are
    taken over if the name is equal and the rows are all there. Returns the version's properties, and whether vectors were reused.
    Two builds at a time: the later one to publish is a Conflict. Old versions go by snapshots.vacuum.
    """
    spark = chunks.sparkSession
    base = snapshots.snapshot(spark, place(path, index_id))
    root = base.path
    kept = chunks.withColumn("index_id", F.lit(index_id))
    staged = {"chunks": snapshots.stage(kept, root, "chunks")}
    rows = spark.read.parquet(f"{root}/{staged['chunks']}")  # from here on the rows as written, however chunks were made
    mark, count = corpus_fingerprint(rows), rows.count()
    name = identity(mark, provider)
    reused = base.properties.get("collection") == name and base.read(spark, "vectors").count() == count
    if not reused:
        staged["vectors"] = snapshots.stage(embedded(rows.select("id", "content"), provider).select("id", "vector"), root, "vectors")
        if spark.read.parquet(f"{root}/{staged['vectors']}").count() != count:
            raise ValueError("the collection has not as many vectors as the index has chunks")
    staged["summaries"] = snapshots.stage(rollup.summaries(rows, index_id, mark), root, "summaries")
    told = {
        "index_id": index_id,
        "fingerprint": mark,
        "collection": name,
        "provider": provider.name,
        "dimensions": provider.dimensions,
        "chunks": count,
        "summaries": spark.read.parquet(f"{root}/{staged['summaries']}").count(),
    }
    new = snapshots.publish(spark, base, staged, told)
    return told | {"reused": reused, "version": new.version}


def read_index(spark: SparkSession, path: str, part: str, index_id: str, version: int | None = None) -> DataFrame:
    """chunks, vectors or summaries of an index, as its latest version has them or the one named."""
    return snapshots.snapshot(spark, place(path, index_id), version).read(spark, part)


def ready(
    spark: SparkSession, path: str, index_id: str, provider: Provider, version: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, summaries) of one version of an index (None: the latest) that is complete and of this provider; an error says
    what is not so. All three stay those of that version, whatever is published later."""
    now = snapshots.snapshot(spark, place(path, index_id), version)
    mark = now.properties
    if now.version < 0:
        raise ValueError(f"index {index_id} is not published")
    if (mark["provider"], mark["dimensions"]) != (provider.name, provider.dimensions):
        raise ValueError(f"index {index_id} has vectors of another provider")
    if mark["collection"] != identity(mark["fingerprint"], provider):
        raise ValueError(f"index {index_id} names another collection than its chunks give")
    parts = [now.read(spark, n) for n in ("chunks", "vectors", "summaries")]
    for name, rows, n in zip(("chunks", "vectors", "summaries"), parts, (mark["chunks"], mark["chunks"], mark["summaries"])):
        if rows.count() != n:
            raise ValueError(f"index {index_id} has not all its {name}")
    return parts[0], parts[1], parts[2]


def lexical(content: Column, location: Column, phrase: Column, words: Column) -> Column:
    """As functions.text.lexical_score, for queries in columns."""
    content, location, phrase = F.lower(F.coalesce(content, F.lit(""))), F.lower(
        F.coalesce(location, F.lit(""))
    ), F.lower(phrase)
    hit = F.when(F.contains(content, phrase) | F.contains(location, phrase), 0.45).otherwise(0.0)
    share = lambda where: F.coalesce(
        F.size(F.filter(words, lambda w: F.contains(where, w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0)
    )
    return F.least(F.lit(1.0), hit + share(content) * 0.4 + share(location) * 0.15)


def hybrid(
    chunks: DataFrame,
    vectors_: DataFrame,
    queries: DataFrame,
    limit: int,
    summaries: DataFrame | None = None,
    known: list[str] | None = None,
    scale: str = "cosine",
) -> DataFrame:
    """The best `limit` chunks for each query, ranked from 1.

    chunks (id, path, symbol, start_line, content), vectors_ (id, vector), queries (query_id, phrase, words array, vector),
    summaries (scope: a chunk's id, content), known: beginnings of paths that are looked at in any case (the first MOST_KNOWN chunks
    by path, line and id). Candidates are each query's nearest vectors, as many as the candidate budget allows, and those known. scale: how a
    cosine becomes a score: affine (from -1..1 to 0..1) or cosine (below 0 is 0).
    """
    if not 1 <= limit <= 1000:
        raise ValueError("1 to 1000 results")
    most = candidate_budget(vectors_.count(), limit)
    score = vectors.affine(F.col("cosine")) if scale == "affine" else F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))
    )
    asked = queries.select("query_id", F.col("vector").alias("query"))
    near = vectors.nearest(vectors_, asked, max(1, most))  # no vectors: no rows
    found = near.select("query_id", "id", score.alias("semantic_score"))
    location = F.lit(0.0)
    if known:
        from quarrylight.operators.search import path_prefixes

        told = path_prefixes(chunks, known).select("id", "path", "start_line").orderBy("path", "start_line", "id").limit(MOST_KNOWN)
        ids = [r.id for r in told.collect()]  # at most MOST_KNOWN
        every = queries.select("query_id", F.explode(F.array(*[F.lit(i) for i in ids]).cast(f"array<{chunks.schema['id'].dataType.simpleString()}>")).alias("id"))
        both = found.unionByName(every.withColumn("semantic_score", F.lit(None).cast("double")))
        found = both.groupBy("query_id", "id").agg(F.max("semantic_score").alias("semantic_score"))
        for p in known:
            location = F.when(F.startswith("path", F.lit(p)), 1.0).otherwise(location)
    phrases = queries.select("query_id", "phrase", "words")
    if queries.count() <= BROADCAST_QUERIES:
        phrases = F.broadcast(phrases)
    where = F.concat("path", F.lit(" "), F.coalesce("symbol", F.lit("")))
    scored = chunks.select("id", "path", "symbol", "start_line", "content").join(found, "id").join(phrases, "query_id").select(
        "query_id",
        "id",
        "path",
        "start_line",
        lexical(F.col("content"), where, F.col("phrase"), F.col("words")).alias("lexical_score"),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        location.alias("location_boost"),
    )
    scored = scored.withColumn(
        "score", ranking.hybrid_score(F.col("lexical_score"), F.col("semantic_score"), F.col("location_boost"))
    ).where("score <> 0")
    scored = scored.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "id")
    # what is ranked has no content; the winners meet theirs afterwards
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("path", "start_line")
    best = chunks.join(best, "id")
    if summaries is None:
        return best.withColumn("summary", F.lit(None).cast("string"))
    return best.join(summaries.select(F.col("scope").alias("id"), F.col("content").alias("summary")), "id", "left")


def render_source(row_symbol: str = "symbol") -> Column:
    """A chunk as a block with its locator: columns id, path, start_line, end_line, language, kind, symbol, start_instruction, end_instruction, content."""
    pairs = [(n, F.col(n).cast("string")) for n in ("id", "path")] + [
        ("lines", F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    ]
    pairs += [(n, F.col(n)) for n in ("language", "kind")] + [("symbol", one_line(F.col(row_symbol)))]
    pairs += [
        (
            "instructions",
            F.concat(F.col("start_instruction").cast("string"), F.lit("-"), F.col("end_instruction").cast("string")),
        )
    ]
    head = F.concat_ws(" ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v)) for n, v in pairs])
    return F.concat(F.lit("[source "), head, F.lit("]\n"), "content", F.lit("\n[/source]"))


def render_summary() -> Column:
    """A chunk's summary as a block with its locator; null where there is none or it is blank."""
    symbol = F.when(
        F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit(" symbol="), one_line(F.col("symbol")))
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit("[summary id="),
        "id",
        F.lit(" path="),
        "path",
        F.lit(" lines="),
        F.col("start_line").cast("string"),
        F.lit("-"),
        F.col("end_line").cast("string"),
        symbol,
    )
    return F.when(F.trim("summary") != "", F.concat(head, F.lit("]\n"), F.trim("summary"), F.lit("\n[/summary]")))


def pack(ranked: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """Ranked rows (of hybrid, with what render_source needs) packed into `budget` tokens: adds representation (source, summary, or
    omitted), estimated_tokens and text, null for what is omitted. Ranks are by score, then path without regard to case, line and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("path"), "start_line", "id")
    rows = ranked.withColumns(
        {"rank": F.row_number().over(order), "_source": render_source(), "_summary": render_summary()}
    )
    sized = rows.select(
        "query_id",
        "rank",
        F.col("id").cast("string").alias("id"),
        F.octet_length("_source").alias("source_bytes"),
        F.octet_length("_summary").alias("summary_bytes"),
    )
    taken = ranking.pack_budget(sized, budget, overhead=overhead).select(
        "query_id", "rank", "representation", "estimated_tokens"
    )
    met = rows.join(taken, ["query_id", "rank"], "left")
    text = F.when(F.col("representation") == "source", F.col("_source")).when(
        F.col("representation") == "summary", F.col("_summary")
    )
    return met.withColumns(
        {"text": text, "representation": F.coalesce("representation", F.lit("omitted"))}
    ).drop("_source", "_summary")


def chunk_files(files: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Line windows of files (path, language, content) with ids, as build takes them."""
    none = F.lit(None).cast("long")
    return chunking.line_windows(files, size, overlap).withColumns(
        {"start_instruction": none, "end_instruction": none}
    ).withColumn("id", chunking.chunk_id())
