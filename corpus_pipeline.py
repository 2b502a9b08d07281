"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.llm.common import fresh, prepare, table, written
from quarrylight.llm.decontaminate import remove_contaminated
from quarrylight.llm.line_dedup import remove_boilerplate
from quarrylight.llm.near_copies import keep_one
from quarrylight.llm.packing import Limits, behind_first_line, pack
from quarrylight.llm.quality_fm import score, train


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.5 go: so a clean one that it is unsure of stays.

    Null and empty texts are scored like any other. A repeated row is judged each time.
    """
    meta = (F.log1p("n_chars"),)
    machine = train(docs, table(spark, sf_dir, "labels"), label_col="quality", meta=meta, max_rows=6000)
    score_col, predicted = fresh(docs.columns, "_score", "_predicted")
    judged = score(
        docs, machine, keep=docs.columns, meta=meta, threshold=0.5, score_col=score_col, predicted_col=predicted
    )
    return judged.where(F.col(predicted) == 1).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of four words or more on eight or more sources go; every document stays, if with less or no text."""
    return remove_boilerplate(docs, min_sites=8, min_words=4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least id. Documents left without a word are one group.

    Linked are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, each link confirmed by
    the sets; SimHash bits only sort out candidates. Rows with a null id stay.
    """
    return keep_one(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words one in twenty or more lies in a 13-word window of the benchmark go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens, with their ids."""
    return pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=1,
        limits=Limits(2048, 128, 2048),
        loss_share=behind_first_line(F.col("text")),
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing)
]

#: The classifier, the fingerprints, and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
