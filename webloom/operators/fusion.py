"""Block fusion (G1-G4) as gaps-and-islands.

A rule only decides, per block, whether it starts a new group
(``new_group``); ``fuse`` numbers the groups with a running sum and merges
each one with a single ``groupBy(doc_id, group)``. The input is already
hash-partitioned by ``doc_id``, so neither the window nor the grouping
shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.classifiers import BLOCK_COLUMNS, MARKUP_PREFIX, STRICTLY_NOT_CONTENT, has, w_doc, w_upto

CONTENT_FUSION_MAX_LINK_DENSITY = 0.56


def fuse(blocks: DataFrame, new_group: Column) -> DataFrame:
    """Merge runs of blocks: text joined by newlines, counts summed, offsets
    min/max, tag level min, labels united, content OR-ed, densities recomputed."""
    g = blocks.withColumn("_ng", new_group).withColumn(
        "_g", F.sum(F.when(F.col("_ng"), 1).otherwise(0)).over(w_upto()))
    has_members = "members" in blocks.columns
    extra = [F.array_sort(F.flatten(F.collect_list("members"))).alias("members")] if has_members else []
    m = g.groupBy("doc_id", "_g").agg(
        *extra,
        F.min("block_idx").alias("block_idx"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]),
                     "\n").alias("text"),
        F.sum("num_words").cast("int").alias("num_words"),
        F.sum("num_anchor_words").cast("int").alias("num_anchor_words"),
        F.sum("num_words_wrapped").cast("int").alias("_ww"),
        F.sum("num_wrapped_lines").cast("int").alias("_wl"),
        F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end"),
        F.min("tag_level").alias("tag_level"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.max(F.col("is_content").cast("int")).cast("boolean").alias("is_content"))
    m = m.select(
        "*",
        F.when(F.col("_ww") == 0, F.col("num_words")).otherwise(F.col("_ww")).alias("num_words_wrapped"),
        F.when(F.col("_ww") == 0, F.lit(1)).otherwise(F.col("_wl")).alias("num_wrapped_lines"))
    m = m.select(
        "*",
        (F.col("num_words_wrapped") / F.col("num_wrapped_lines")).cast("double").alias("text_density"),
        F.when(F.col("num_words") == 0, F.lit(0.0)).otherwise(F.col("num_anchor_words") / F.col("num_words"))
        .cast("double").alias("link_density"))
    return m.select(*BLOCK_COLUMNS, *(["members"] if has_members else []))


def proximity_fusion(blocks: DataFrame, max_distance: int = 1, content_only: bool = False,
                     same_level: bool = False) -> DataFrame:
    """G1: a content block joins the previous one when their offsets are at
    most ``max_distance`` apart (and the previous is content / on the same tag
    level when asked). Documents with one block stay as they are."""
    w = w_doc()
    prev_end, prev_content, prev_level = (F.lag(c).over(w) for c in ("offset_end", "is_content", "tag_level"))
    join = (F.col("is_content") & prev_end.isNotNull()
            & (F.col("offset_start") - prev_end - 1 <= max_distance))
    if content_only:
        join = join & prev_content
    if same_level:
        join = join & (F.col("tag_level") == prev_level)
    return fuse(blocks, ~F.coalesce(join, F.lit(False)))


def density_fusion(blocks: DataFrame) -> DataFrame:
    """Neighbours with equal text density merge."""
    prev = F.lag("text_density").over(w_doc())
    return fuse(blocks, ~F.coalesce(prev == F.col("text_density"), F.lit(False)))


def label_fusion(blocks: DataFrame) -> DataFrame:
    """Neighbours that both carry labels and have equal markup labels merge."""
    markup = lambda c: F.array_sort(F.filter(c, lambda x: x.startswith(MARKUP_PREFIX)))
    prev = F.lag("labels").over(w_doc())
    join = (F.size(prev) > 0) & (F.size("labels") > 0) & (markup(prev) == markup(F.col("labels")))
    return fuse(blocks, ~F.coalesce(join, F.lit(False)))


def content_fusion(blocks: DataFrame) -> DataFrame:
    """A content block absorbs the following blocks with link density
    below 0.56 that are not STRICTLY_NOT_CONTENT (one pass)."""
    w = w_doc()
    ok = (F.col("link_density") < CONTENT_FUSION_MAX_LINK_DENSITY) & ~has(STRICTLY_NOT_CONTENT)
    first = F.row_number().over(w) == 1
    d = blocks.select("*", ok.alias("_ok"), first.alias("_first"))
    d = d.select(
        "*",
        F.max(F.when(F.col("is_content"), F.col("block_idx"))).over(w_upto()).alias("_lc"),
        F.max(F.when(~F.col("_ok") | F.col("_first"), F.col("block_idx"))).over(w_upto()).alias("_lh"))
    d = d.select("*", F.lag("_lc").over(w).alias("_plc"), F.lag("_lh").over(w).alias("_plh"))
    join = F.col("_ok") & ~F.col("_first") & F.col("_plc").isNotNull() & (F.col("_plc") >= F.col("_plh"))
    d = d.withColumn("_join", F.coalesce(join, F.lit(False)))
    keep = [c for c in ("members",) if c in blocks.columns]
    return fuse(d.select(*BLOCK_COLUMNS, *keep, "_join"), ~F.col("_join"))
