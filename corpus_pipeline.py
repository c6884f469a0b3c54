"""Corpus pipeline: language ID, toxicity, near-duplicate removal, packing.

Every stage but the last returns the columns of documents and works on all that its predecessor kept. Each result is
written as Parquet in the shared folder and read again, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import langid, minhash, packing, toxicity
from chunkloom.llm._common import Scratch, read


def _masked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with columns c0, c1, ..., so that none clashes with what an operator adds; and the text's new name."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without text or letters go. Repeated rows are judged alike, each by itself; a null doc_id is no hindrance. An empty table stays empty."""
    profiles = langid.fit_profiles(docs.filter(~langid.held_out()))
    masked, text = _masked(docs)
    said = langid.predict_languages(masked.withColumn("read", F.col(text)), profiles, text_col="read", keep=masked.columns)
    return said.filter("lang_pred <> 'und'").select(*masked.columns).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay, those without text among them. Repeated rows are judged alike, each by itself; a null doc_id is never a
    training row. With no toxic label, or an empty table, everything stays."""
    lexicon = toxicity.fit_lexicon(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    masked, text = _masked(docs)
    scored = toxicity.score_toxicity(masked, lexicon, text_col=text, keep=masked.columns)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*masked.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id stays of each group; a null doc_id is in no group. Repeated rows of one doc_id: one stays."""
    found = minhash.near_duplicates(docs)
    gone = found.filter("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if not _repeats(docs):
        return kept
    none = kept.filter("doc_id IS NULL")
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(none)


def _repeats(docs: DataFrame) -> bool:
    return not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence. Repeated rows and ids are separate items; documents without words have one row
    without a bin. An empty table gives an empty result."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Profiles, lexicon and packing are no SQL; the tests hold the pipeline against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
