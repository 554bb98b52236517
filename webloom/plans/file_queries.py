"""Queries of the file sources and sinks: tables written as files in the shared scratch folder and read back, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.catalog import register
from webloom.session import scratch_path
from webloom.sources import files
from webloom.sources.tables import documents

#: Documents of a file that is read whole.
DOCS_PER_FILE = 64
MARKER = "cw-data/"
ORACLES: dict[str, str] = {}


def _out(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _tree(spark: SparkSession, sf: str) -> str:
    """The documents' ids as text files in folders by language and source, under a marked root."""
    root = _out(spark, "tree") + "/" + MARKER
    _texts(spark, sf).select("lang", "source", F.col("doc_id").cast("string").alias("value")).write.partitionBy(
        "lang", "source").text(root)
    return root


def _folders(listing: DataFrame, column: str) -> DataFrame:
    """The folders of relative paths, once each: how many part files they hold is Spark's matter."""
    return listing.select(F.regexp_replace(column, "/[^/]*$", "").alias("folder")).distinct()


@register("read_whole_files")
def q_read_whole_files(spark, sf):
    """Files of ``DOCS_PER_FILE`` documents, a row each, with what they hold."""
    out = _out(spark, "whole")
    part = F.floor(F.col("doc_id") / DOCS_PER_FILE).alias("part")
    lines = _texts(spark, sf).groupBy(part).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda t: t.text), "\n").alias("value"))
    lines.write.partitionBy("part").text(out)
    whole = files.read_whole_files(spark, out)
    return whole.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"),
                        F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


ORACLES["read_whole_files"] = f"""
SELECT part, length(c) AS n_chars, sha256(c) AS content_sha256
FROM (SELECT cast(floor(doc_id / {DOCS_PER_FILE}) AS bigint) AS part,
             string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS c FROM documents GROUP BY 1)"""


@register("seqfile_round_trip")
def q_seqfile(spark, sf):
    """Texts exported as sequence files, keys naming their input, and read back."""
    out = _out(spark, "seqfiles")
    files.write_seqfile(_texts(spark, sf).withColumnRenamed("source", "rel"), out)
    back = files.read_seqfile(spark, out, with_rel=True)
    return back.select("rel", F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


ORACLES["seqfile_round_trip"] = """
SELECT coalesce(source, '') AS rel, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


@register("write_texts")
def q_write_texts(spark, sf):
    """Converted texts as Parquet with a folder per input, read back."""
    out = _out(spark, "texts")
    files.write_texts(_texts(spark, sf).select("doc_id", "text", F.col("source").alias("rel")), out)
    return spark.read.parquet(out).select("doc_id", F.col("rel").cast("string").alias("rel"), F.sha2("text", 256).alias("text_sha256"))


ORACLES["write_texts"] = "SELECT doc_id, source AS rel, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


@register("list_files")
def q_list_files(spark, sf):
    """All files of a tree with a suffix, by their folders below its root."""
    listed = files.list_files(spark, _tree(spark, sf)).where(files.has_suffix(F.col("path"), ".txt"))
    return _folders(listed.select(files.relative_path(F.col("path"), MARKER).alias("rel")), "rel")


@register("list_three_levels")
def q_list_three_levels(spark, sf):
    """Files two folders below a root; those of other depths are not listed."""
    root = _tree(spark, sf)
    spark.range(1).select(F.lit("x").alias("value")).write.text(root + "/top")
    listed = files.list_three_levels(spark, root)
    return _folders(listed.select(files.relative_path(F.col("path"), MARKER).alias("rel")), "rel")


_FOLDER = "'lang=' || lang || '/source=' || source"
ORACLES["list_files"] = ORACLES["list_three_levels"] = f"SELECT DISTINCT {_FOLDER} AS folder FROM documents"


@register("incremental_inputs")
def q_incremental_inputs(spark, sf):
    """The inputs that are left once those of one language are marked as done."""
    root, out = _tree(spark, sf), _out(spark, "converted")
    first = files.incremental_inputs(spark, root, out, ".txt", MARKER)
    files.mark_done(spark, first.where(F.col("rel").startswith("lang=en/")), out)
    return _folders(files.incremental_inputs(spark, root, out, ".txt", MARKER), "rel")


ORACLES["incremental_inputs"] = f"SELECT DISTINCT {_FOLDER} AS folder FROM documents WHERE lang <> 'en'"


@register("write_text_per_doc")
def q_write_text_per_doc(spark, sf):
    """A line per document in bucketed text files, read back as lines."""
    out = _out(spark, "text-per-doc")
    files.write_text_per_doc(_texts(spark, sf), out)
    line = F.split("value", "\t", 2)
    return files.read_text(spark, out, recursive=True).select(
        line.getItem(0).cast("long").alias("doc_id"), F.sha2(line.getItem(1), 256).alias("text_sha256"))


ORACLES["write_text_per_doc"] = r"""
SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS text_sha256 FROM documents"""


@register("save_text")
def q_save_text(spark, sf):
    """The distinct words of the documents as text files, read back by a glob."""
    out = _out(spark, "words")
    words = _texts(spark, sf).select(F.explode(F.split("text", r"[ \r\n]+")).alias("value")).where("value <> ''").distinct()
    files.save_text(words, out)
    return files.read_text(spark, out + "/part-", glob_all=True).select(F.col("value").alias("word"))


ORACLES["save_text"] = r"""
SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \r\n]+')) AS w FROM documents) WHERE w <> ''"""
