"""Anchors, images, highlighting, conditional labels.

All of them work on the event table and the block table of the same pages;
both are hash-partitioned by ``doc_id`` (see ``html_events``), so every
window and join here is keyed by ``doc_id`` without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.tokens import JAVA_WHITESPACE
from webloom.operators.html import IMPLIED_END

# Elements whose content the image scan ignores. Void elements
# (LINK, EMBED) have none and never close, so they do not count.
IMAGE_IGNORED = ("HEAD", "STYLE", "SCRIPT", "NOSCRIPT", "APPLET")


def _w():
    return Window.partitionBy("doc_id").orderBy("pos")


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute in a raw attribute string (quoted or bare), or null."""
    pat = r"(?i)(?:^|\s)" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    v = F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2), F.regexp_extract(attrs, pat, 3))
    return F.when(attrs.rlike(pat), v)


def _with_state(events: DataFrame) -> DataFrame:
    w = _w()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    a_start = (F.col("tag") == "A") & (F.col("kind") == "start")
    a_end = (F.col("tag") == "A") & (F.col("kind") == "end")
    return events.select(
        "*",
        F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        .alias("run_idx"),
        F.sum(F.when(a_start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("anchor_no"),
        F.coalesce(F.last(F.when(a_start, True).when(a_end, False), ignorenulls=True).over(before), F.lit(False))
        .alias("in_a"))


def anchors(events: DataFrame) -> DataFrame:
    """anchors(doc_id, anchor_no, run_idx, anchor_text, href): the trimmed
    text runs between <a> and </a> concatenated; run_idx is the index of the
    anchor's last text run (the key the block's text runs are matched on)."""
    st = _with_state(events)
    starts = st.where((F.col("tag") == "A") & (F.col("kind") == "start")).select(
        "doc_id", "anchor_no", attr(F.col("attrs"), "href").alias("href"))
    texts = st.where((F.col("kind") == "text") & F.col("in_a")).groupBy("doc_id", "anchor_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace(
            "text", JAVA_WHITESPACE, " ")).alias("t")))), lambda x: x["t"]), "").alias("anchor_text"),
        F.max("run_idx").alias("run_idx"))
    return starts.join(texts, ["doc_id", "anchor_no"], "left").select(
        "doc_id", "anchor_no", "run_idx", F.coalesce("anchor_text", F.lit("")).alias("anchor_text"), "href")


def event_blocks(events: DataFrame, blocks_with_owner: DataFrame) -> DataFrame:
    """Text events with the block that holds them: (doc_id, pos, run_idx, block_idx)."""
    from webloom.operators.html import _running_state, DEFAULT_TAG_ACTIONS
    st = _running_state(events, DEFAULT_TAG_ACTIONS)
    owner = F.when(F.col("is_trigger"), F.col("grp") - 1).otherwise(F.col("grp"))
    runs = F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(
        _w().rowsBetween(Window.unboundedPreceding, 0))
    ev = (st.select("doc_id", "pos", "kind", "text", owner.alias("owner"), runs.alias("run_idx"))
          .where(F.col("kind") == "text"))
    return ev.join(blocks_with_owner.select("doc_id", "owner", "block_idx"), ["doc_id", "owner"]).select(
        "doc_id", "pos", "run_idx", "block_idx", "text")


def anchors_in_blocks(events: DataFrame, blocks_with_owner: DataFrame) -> DataFrame:
    """Anchors whose key text run lies in a block."""
    eb = event_blocks(events, blocks_with_owner).select("doc_id", "run_idx", "block_idx")
    return anchors(events).join(eb, ["doc_id", "run_idx"]).select(
        "doc_id", "block_idx", "anchor_no", "run_idx", "anchor_text", "href")


def image_area(width: Column, height: Column) -> Column:
    """width*height when both parse as integers, else -1."""
    wi = F.when(width.rlike(r"^\s*[0-9]{1,9}\s*$"), F.trim(width).cast("long"))
    hi = F.when(height.rlike(r"^\s*[0-9]{1,9}\s*$"), F.trim(height).cast("long"))
    return F.coalesce(wi * hi, F.lit(-1)).cast("long")


def content_images(events: DataFrame, final_blocks: DataFrame, blocks_with_owner: DataFrame) -> DataFrame:
    """images(doc_id, pos, src, width, height, alt, area) seen while the
    latest non-blank text run was content and followed later by a content run.

    ``final_blocks`` are extractor output carrying ``members`` (original block
    ids); ``blocks_with_owner`` maps original blocks to event groups.
    """
    content_members = final_blocks.where("is_content").select("doc_id", F.explode("members").alias("block_idx"))
    eb = event_blocks(events, blocks_with_owner).join(content_members.withColumn("_c", F.lit(True)),
                                                       ["doc_id", "block_idx"], "left")
    core = eb.where(F.regexp_replace("text", JAVA_WHITESPACE, "") != "").select(
        "doc_id", "pos", F.coalesce("_c", F.lit(False)).alias("content"))
    imgs = events.where((F.col("kind") == "start") & (F.col("tag") == "IMG")).select(
        "doc_id", "pos", attr(F.col("attrs"), "src").alias("src"), attr(F.col("attrs"), "width").alias("width"),
        attr(F.col("attrs"), "height").alias("height"), attr(F.col("attrs"), "alt").alias("alt"))
    # ignorable context of each event
    ign = events.select(
        "doc_id", "pos",
        (F.sum(F.when(F.col("tag").isin(*IMAGE_IGNORED) & (F.col("kind") == "start")
                      & ~F.col("tag").isin(*IMPLIED_END), 1)
               .when(F.col("tag").isin(*IMAGE_IGNORED) & (F.col("kind") == "end"), -1).otherwise(0))
         .over(_w().rowsBetween(Window.unboundedPreceding, -1)) > 0).alias("ignored"))
    marks = (core.select("doc_id", "pos", F.col("content").alias("c"), F.lit(None).cast("string").alias("src"),
                         F.lit(None).cast("string").alias("width"), F.lit(None).cast("string").alias("height"),
                         F.lit(None).cast("string").alias("alt"))
             .unionByName(imgs.select("doc_id", "pos", F.lit(None).cast("boolean").alias("c"), "src", "width",
                                      "height", "alt")))
    w = _w()
    m = marks.select("*",
                     F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_c"),
                     F.max(F.when(F.col("c"), F.col("pos"))).over(Window.partitionBy("doc_id")).alias("last_c"))
    picked = m.where(F.col("c").isNull() & F.coalesce(F.col("prev_c"), F.lit(False)) & (F.col("last_c") > F.col("pos"))
                     & (F.col("src") != ""))
    picked = picked.join(ign, ["doc_id", "pos"]).where(~F.coalesce("ignored", F.lit(False)))
    return picked.select("doc_id", "pos", "src", "width", "height", "alt",
                         image_area(F.col("width"), F.col("height")).alias("area"))


def rank_images(images: DataFrame) -> DataFrame:
    """Images per document by area descending, then src, then place."""
    w = Window.partitionBy("doc_id").orderBy(F.col("area").desc(), F.col("src"), F.col("pos"))
    return images.withColumn("rank", F.row_number().over(w) - 1)


def xml_escape(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def highlight(events: DataFrame, final_blocks: DataFrame, blocks_with_owner: DataFrame,
              pre: str = "<span class=\"x-content\">", post: str = "</span>", only_content: bool = False) -> DataFrame:
    """The page rebuilt from its events with content text runs wrapped in
    ``pre``/``post`` (text XML-escaped); ``only_content`` keeps just the
    marked content text. Returns (doc_id, html)."""
    content_members = final_blocks.where("is_content").select("doc_id", F.explode("members").alias("block_idx"))
    eb = event_blocks(events, blocks_with_owner).join(content_members.withColumn("_c", F.lit(True)),
                                                       ["doc_id", "block_idx"], "left") \
        .select("doc_id", "pos", F.coalesce("_c", F.lit(False)).alias("content"))
    ev = events.join(eb, ["doc_id", "pos"], "left")
    tag = F.lower(F.col("tag"))
    text = xml_escape(F.col("text"))
    marked = F.when(F.col("content"), F.concat(F.lit(pre), text, F.lit(post))).otherwise(text)
    if only_content:
        piece = F.when((F.col("kind") == "text") & F.col("content"), marked)
    else:
        piece = (F.when(F.col("kind") == "start", F.concat(F.lit("<"), tag, F.when(F.col("attrs") != "", F.concat(
            F.lit(" "), F.col("attrs"))).otherwise(F.lit("")), F.lit(">")))
                 .when(F.col("kind") == "end", F.concat(F.lit("</"), tag, F.lit(">")))
                 .otherwise(marked))
    return ev.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x["p"]), "").alias("html"))


def conditional_label(blocks: DataFrame, condition: Column, *labels: str) -> DataFrame:
    """Add labels to the blocks meeting a predicate."""
    added = F.array_sort(F.array_union(F.col("labels"), F.array(*[F.lit(x) for x in labels])))
    return blocks.withColumn("labels", F.when(condition, added).otherwise(F.col("labels")))
