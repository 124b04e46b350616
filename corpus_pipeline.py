"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, mixing.

Every stage reads all that the one before it kept; its result is written and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tessera.llm.queries import DOMAIN_SQL, table
from tessera.plans.stage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones, rejects go; no label is an input of the decision."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs.select(*COLUMNS), model, keep=["lang", "source", "n_chars"], with_text=True)
    return judged.where("predicted = 0").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which nothing is left goes too."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_deleted = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = simhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with how often: weights alike at each level, as many tokens as there are, two epochs at most."""
    taken = mixing.mix(docs.select(*COLUMNS), F.expr(DOMAIN_SQL)).where("copies > 0")
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Toxicity and near-duplicates are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
