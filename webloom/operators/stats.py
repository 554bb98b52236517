"""Document statistics and the quality estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the quality estimate.
MIN_WORDS_BEFORE = 90
MIN_WORDS_AFTER = 70
MIN_AVG_WORDS_AFTER = 25


def doc_stats(blocks: DataFrame, content_only: bool = False) -> DataFrame:
    """(doc_id, num_words, num_blocks, avg_words) over all or content blocks.
    Grouped by doc_id on doc_id-partitioned blocks: no exchange."""
    b = blocks.where(F.col("is_content")) if content_only else blocks
    return b.groupBy("doc_id").agg(
        F.sum("num_words").cast("long").alias("num_words"), F.count(F.lit(1)).alias("num_blocks"),
        (F.sum("num_words") / F.count(F.lit(1))).cast("double").alias("avg_words"))


def low_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, low_quality) from statistics before and after extraction;
    a document without content blocks has 0 words after (average NaN -> low)."""
    b = before.select("doc_id", F.col("num_words").alias("wb"))
    a = after.select("doc_id", F.col("num_words").alias("wa"), F.col("avg_words").alias("aa"))
    j = b.join(a, "doc_id", "left")
    low = (F.col("wb") < MIN_WORDS_BEFORE) | (F.coalesce("wa", F.lit(0)) < MIN_WORDS_AFTER) | \
        (F.coalesce("aa", F.lit(float("nan"))) < MIN_AVG_WORDS_AFTER)
    return j.select("doc_id", low.alias("low_quality"))
