"""Resumable crawl -> text conversion (S10, S12) on Structured Streaming.

New WARC files under the input folder are picked up by a file stream (the
record separator is the line separator, so large files split across
tasks); each micro-batch runs the batch pipeline (events -> blocks ->
extractor -> cleaning) through ``foreachBatch`` and appends parquet
partitioned by the input file. The stream's checkpoint remembers which
files were processed, so a rerun with ``trigger(availableNow=True)``
converts only new files, also in another process: the checkpoint lies under
the output folder. Each batch overwrites a folder of its own number, so a
batch that failed half-way is redone, not duplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.cleaning import clean_text
from webloom.plans.extractors import extract
from webloom.sources.crawl import RECORD_SEPARATOR, parse_warc_records, responses
from webloom.sources.files import done_table_path, relative_path


def convert_batch(records: DataFrame, extractor: str = "article", root_marker: str = "cw-data/",
                  clean: bool = True) -> DataFrame:
    """Batch step: raw record texts (value, path) -> (doc_id, text, rel)."""
    crawl = responses(parse_warc_records(records)).where(F.col("trec_id").isNotNull())
    pages = crawl.select(F.col("trec_id").alias("page_id"), "url", "html")
    rels = crawl.select(F.col("trec_id").alias("doc_id"), relative_path(F.col("path"), root_marker).alias("rel"))
    texts = extract(pages, extractor).select("doc_id", "text")
    out = texts.join(rels, "doc_id")
    return out.withColumn("text", clean_text(F.col("text"))) if clean else out


def start_conversion(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str | None = None,
                     extractor: str = "article", glob: str = "*.warc", max_files_per_trigger: int | None = None,
                     available_now: bool = True, root_marker: str = "cw-data/"):
    """Start (and with ``available_now`` run to completion) the conversion stream."""
    root = out_dir.rstrip("/")
    reader = (spark.readStream.format("text").option("lineSep", RECORD_SEPARATOR)
              .option("pathGlobFilter", glob).option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(input_dir).select("value", F.col("_metadata.file_path").alias("path"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        converted = convert_batch(batch, extractor, root_marker)
        converted.write.mode("overwrite").partitionBy("rel").parquet(f"{root}/batch={batch_id}")
        # Done markers, written after the texts of the batch
        batch.select(relative_path(F.col("path"), root_marker).alias("rel")).distinct() \
            .write.mode("overwrite").parquet(f"{done_table_path(root)}/batch={batch_id}")

    ckpt = checkpoint or f"{root}/_checkpoint"
    writer = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
