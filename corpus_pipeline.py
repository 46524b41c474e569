"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept, written as Parquet and read again: documents
of poor quality go, boilerplate lines go, one document of each group of near copies stays,
contaminated documents go, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echosieve.llm import decontaminate, line_dedup, near_dedup, packing, quality
from echosieve.llm.common import may_broadcast
from echosieve.llm.queries import PACKING_RANKS, tokenizer_path
from echosieve.workspace import Workspace

DROPPED_BYTES = 16 << 20
#: Near copies of the corpus: Jaccard similarity of word shingles.  op10's own values differ.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _without(docs: DataFrame, dropped: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` apart from the ids in ``dropped``; rows without an id stay.

    The ids are written at once, so the tables in ``work`` that they come from can go.
    """
    ids = Workspace(docs.sparkSession).table(dropped.select("doc_id").distinct(), "dropped")
    work.remove()
    return docs.join(may_broadcast(ids, 16, DROPPED_BYTES), "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, with the columns of ``docs``.

    Null and empty texts, which have no words, stay; repeated rows and null ids are judged like
    any other; a long text is judged as a whole; no rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    work = Workspace(spark)
    judged = quality.classify(docs, labels, work)
    work.remove()  # the fitted model does not need the tables it was fitted from
    return judged.filter("accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the boilerplate lines of their ``source``; ``n_chars`` is corrected.

    Null texts stay null, a text of boilerplate becomes empty; null sources are one host; repeated
    rows count as pages; a long text loses lines like a short one; no rows give none.
    """
    return line_dedup.drop_lines(docs, Workspace(spark)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of every group of near copies, and all rows in none.

    Texts without words, null ones included, link to nothing and stay; so do rows without an id
    that copy no other. Rows that repeat an id stay or go together; no rows give none.  A long
    text's shingles are held by one task.
    """
    work = Workspace(spark)
    found = near_dedup.near_duplicates(docs, work, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)
    return _without(docs, found.filter("not kept"), work)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in passages of the benchmark.

    Null and empty texts and rows without an id stay; rows that repeat an id go together; a long
    text is searched as a whole; no rows, or an empty benchmark, change nothing.
    """
    work = Workspace(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, work)
    return _without(docs, found.filter("contaminated"), work)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of at most 2048 tokens and its place in a sequence.

    A null or empty text is its end mark alone; repeated rows and null ids are packed each; only
    texts longer than a sequence are cut; no rows give none.
    """
    return packing.pack(docs, Workspace(spark), tokenizer_path(PACKING_RANKS))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier is trained, which SQL cannot express; tests/llm checks every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to shared storage."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
