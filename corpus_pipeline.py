"""Corpus preparation: the stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from plumbline.llm.common import materialise, table
from plumbline.llm.minhash import one_of_each_group
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import find_personal_data, sanitised
from plumbline.llm.quality_classifier import classify_quality
from plumbline.llm.quality_rules import quality_rules, trusted_ids
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the surface rules and the n-gram ratio to reviewed good documents let pass."""
    return quality_rules(docs, trusted_ids(spark, sf_dir)).where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labelled ones among these, scores as good."""
    return classify_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced by their kind; n_chars follows the text."""
    found = find_personal_data(docs)
    text = sanitised(F.col("row.text"), F.col("found"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_near_dedup", near_dedup), ("pii", personal_data), ("best_fit_packing", packing)]

#: Hash functions and models of the stages have no DuckDB form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
