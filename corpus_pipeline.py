"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Every stage takes all that the one before has kept and returns the columns of
``documents``; the last adds each document's rate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontam, linededup, mixing, simhash, toxicity
from webloom.llm.common import written
from webloom.session import scratch_path
from webloom.sources.tables import load_table


#: Targets of the domains that the first stage leaves.
MIX_TARGETS = {domain: share for domain, share in mixing.TARGETS.items() if domain != "toxic"}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    scored = toxicity.toxicity(docs, load_table(spark, sf_dir, "labels"))
    return scored.filter(~F.col("rejected")).select(*docs.columns)


def drop_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; those of which no word is left go."""
    kept = linededup.dedup_lines(docs)
    kept = kept.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", size).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash group: that of smallest doc_id, nulls last, then of smallest text hash.

    Rows get a key of their own, written with them, so that rows without doc_id
    or with the same one are told apart. Texts meet the keys of the rows that
    go, which are few where most texts differ, so that texts then aren't shuffled.
    """
    keyed = written(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed-documents")
    first = simhash.group_firsts(keyed, "__key")
    gone = written(keyed.select("__key").join(first, "__key", "left_anti"), "later-in-group")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not reject."""
    found = decontam.contamination(docs, load_table(spark, sf_dir, "benchmark"))
    return found.filter(~decontam.is_contaminated()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the rates at which their domains' tokens meet the targets.

    The first stage rejects toxic documents, so the toxic domain has no target
    here and the others' keep their proportion. Posteriors are fitted on the
    labelled documents of the whole table, those that stages removed included.
    """
    labels = load_table(spark, sf_dir, "labels").filter("toxic = 0")
    return mixing.mix(docs, labels, MIX_TARGETS, fitted_on=load_table(spark, sf_dir, "documents"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_later_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifiers and the set-similarity join have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the table ``documents`` of ``sf_dir``."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
