"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.llm.common import shared_path, table


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Null and empty texts are one end id; repeated rows are packed each; an
    empty table gives no row. A document of several lines bears loss behind its first line only, in proportion to bytes.
    """
    from quarrylight.llm.packing import Limits, behind_first_line, pack

    limits = Limits(tokens=2048, segments=128, loss_tokens=2048)
    pieces = pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=1,
        limits=limits,
        loss_share=behind_first_line(F.col("text")),
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document. Null and empty texts have no words and fail; repeated rows each come back;
    an empty table gives no row; no labels of quality 1: every n-gram weighs by the smoothing alone.
    """
    from quarrylight.llm.quality_rules import judge, log_ratios

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = judge(docs, log_ratios(docs, trusted), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of every document, read back. Null and empty texts are one end id; a null id comes first;
    repeated rows are written each; an empty table gives no row.
    """
    from quarrylight.llm.token_blocks import read_tokens, write_tokens

    folder = shared_path(spark, "tokens")
    write_tokens(
        table(spark, sf_dir, "documents"),
        folder,
        public_tokenizers.path("word_bpe_49k.json"),
        end_id=2,
        shard_bytes=1 << 30,
    )
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of every document. Null and empty texts have no words; repeated rows are marked each; no items: no
    hits; words of an item without an id count as hit; an empty table gives no row.
    """
    from quarrylight.llm.decontaminate import contaminated, mark

    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], window=13)
    c = F.col("contamination")
    return marked.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op5_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, read back. A null payload is empty; equal rows of the largest page_id are all
    responses; a null id is never referred to; an empty table gives no row.
    """
    from quarrylight.llm.warc import read_warc, write_warc

    folder = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder, shard_bytes=4 << 30, roll_bytes=1 << 30, revisit_bytes=0)
    return read_warc(spark, folder).select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Texts without words have fingerprint 0 and link like others; repeated rows each
    come back; a null id gets its fingerprint's component; an empty table gives no row.
    """
    from quarrylight.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _remainder(n: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document. Null and empty texts are their end alone; repeated rows are learnt from and scored each; nothing to
    learn from: every word is unseen; an empty table gives no row.
    """
    from quarrylight.llm.hmm_lm import language_model

    return language_model(table(spark, sf_dir, "documents"), train=_remainder(7) != 2)


def op8_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Null texts and those without a letter are `und`, and so is all if there is no language to
    learn; of equal languages the first by name; repeated rows each come back; an empty table gives no row.
    """
    from quarrylight.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(_remainder(5) != 0))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op9_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document. Empty texts are scored like others; no labels: 0.5 for all; a null n_chars is 0; repeated rows
    each come back; an empty table gives no row.
    """
    from quarrylight.llm.quality_fm import score, train

    docs, meta = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), (F.log1p("n_chars"),)
    machine = train(
        docs, table(spark, sf_dir, "labels").where(_remainder(4) != 2), label_col="quality", meta=meta, max_rows=6000
    )
    return score(docs, machine, keep=["doc_id"], meta=meta, threshold=0.7).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its boilerplate lines. Null texts stay null; a null source counts for no site; repeated rows each come
    back; an empty table gives no row.
    """
    from quarrylight.llm.line_dedup import remove_boilerplate

    return remove_boilerplate(
        table(spark, sf_dir, "documents"), min_sites=8, min_words=4, counts=True
    ).select("doc_id", "text", "n_chars", "n_lines", "n_removed")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector. Null vectors and those with a null, NaN or infinite component go; repeated rows each
    come back; null labels are one label; an empty table gives no row.
    """
    from quarrylight.llm.common import written
    from quarrylight.llm.vector_codes import digest, encode, train, with_total

    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors, parts=8, entries=16, rounds=6, scale=4096)
    coded = written(encode(vectors, books, keep=["vec_id", "label"], scale=4096), "codes")
    told = with_total(coded, "label", "error", "label_error")
    return told.select(
        "vec_id", "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256")
    )


def _with_repetition(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id as text) is a multiple of 10, each word i >= a is original word a + (i - a) % p, with
    g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8). A null id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", "[ \\t-\\r]+"), "")

    def repeated(w: F.Column) -> F.Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.when(
            n > 0,
            F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "),
        )

    # the words are bound once, as each word looks into them
    bound = F.get(F.transform(F.array(words), repeated), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(bound, "text")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests. Null and empty texts have no words and no runs; repeated rows each come
    back; an empty table gives no row.
    """
    from quarrylight.llm.periodic_runs import find_runs, longest

    docs = _with_repetition(table(spark, sf_dir, "documents"))
    found = find_runs(docs, keep=["doc_id"], min_words=12).select(
        "doc_id", "repetition.runs", "repetition.collapsed", longest(F.col("repetition.runs")).alias("best")
    )
    line = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the phrases and labels of every document. Null and empty texts have no words; repeated rows each come back; an empty
    table gives no row.
    """
    from quarrylight.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    at, label = F.transform("license.places", lambda p: p.at), F.transform("license.places", lambda p: p.label)
    return found.select(
        "doc_id",
        "license.n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label)), ",").alias("base_labels"),
        F.array_join("license.labels", ",").alias("labels"),
        "license.score",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage of corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10, "op11_vector_codes": op11()}


def op11(rounds: int = 6) -> str:
    """SQL of op11_vector_codes: one pair of tables for each round."""
    near = """a{i} AS MATERIALIZED (
SELECT row, part, min(far * 16 + entry) // 16 AS far, min(far * 16 + entry) % 16 AS entry FROM (
SELECT v.row, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS far FROM v JOIN c{i} c USING (part, place) GROUP BY ALL)
GROUP BY ALL)"""
    mean = """c{n} AS MATERIALIZED (
SELECT c.part, c.entry, c.place, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
SELECT part, entry, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} USING (row, part) GROUP BY ALL)) m USING (part, entry, place))"""
    steps = [x.format(i=i, n=i + 1) for i in range(rounds) for x in (near, mean)] + [near.format(i=rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row FROM embeddings
WHERE embedding IS NOT NULL AND len([z FOR z IN embedding IF z IS NULL OR NOT isfinite(z)]) = 0),
cut AS (SELECT row, len(embedding) // 8 AS width, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS spot FROM kept),
v AS MATERIALIZED (SELECT row, spot // width AS part, spot % width AS place, floor(4096 * e::DOUBLE)::BIGINT AS x FROM cut),
c0 AS (SELECT part, row AS entry, place, x FROM v WHERE row < 16),
{", ".join(steps)},
found AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY 1),
whole AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS books FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books AS codebooks_sha256
FROM kept JOIN found USING (row), whole
"""


#: Lines of at least 4 words on at least 8 distinct sources go; the rest of each text stays.
OP10 = """
WITH cut AS (SELECT doc_id, text, n_chars, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, source, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM cut),
marked AS (SELECT *, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, regexp_matches(l, '^[ \\t-\\r]*[^ \\t-\\r]+[ \\t-\\r]+[^ \\t-\\r]+[ \\t-\\r]+[^ \\t-\\r]+[ \\t-\\r]+[^ \\t-\\r]') AS long FROM line),
spread AS (SELECT t AS b FROM marked WHERE long GROUP BY 1 HAVING count(DISTINCT source) >= 8),
flagged AS (SELECT m.*, long AND b IS NOT NULL AS gone FROM marked m LEFT JOIN spread ON t = b),
kept AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS stay, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM flagged GROUP BY 1)
SELECT doc_id, CASE WHEN n_removed = 0 THEN text ELSE stay END AS text, CASE WHEN n_removed = 0 THEN n_chars ELSE length(stay) END AS n_chars, n_lines, n_removed
FROM cut JOIN kept USING (doc_id)
"""
