"""Opt-in markup labels (H12) and font-size labels.

Both need the elements open at a position. For properly nested elements
the element open at depth k before position p is the last start at depth k
before p, so "open elements" is an as-of lookup: probe rows for every depth
below the probe's own are unioned with the element starts, and a window
over ``(doc_id, depth) ORDER BY pos`` carries the last start forward. No
range join, no per-page stack; everything stays keyed by doc_id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.tokens import JAVA_WHITESPACE
from webloom.operators.html import DEFAULT_TAG_ACTIONS, VOID_TAGS
from webloom.operators.html_extras import attr, event_blocks

MARKUP_PREFIX = "<"
DEFAULT_FONT_SIZE = 3


# Starts that end an open element without its end tag, by the open element, and what hides it from them.
ENDS_PARAGRAPH = ("ADDRESS", "ARTICLE", "ASIDE", "BLOCKQUOTE", "DIV", "DL", "DD", "DT", "FIELDSET", "FIGURE", "FOOTER", "FORM",
                  "H1", "H2", "H3", "H4", "H5", "H6", "HEADER", "HR", "LI", "MAIN", "NAV", "OL", "P", "PRE", "SECTION", "TABLE", "UL")
ENDED_BY = {"P": ENDS_PARAGRAPH, "LI": ("LI",), "DT": ("DT", "DD"), "DD": ("DT", "DD"), "TR": ("TR",), "TD": ("TD", "TH", "TR"),
            "TH": ("TD", "TH", "TR")}
SCOPES = {"LI": ("UL", "OL"), "DT": ("DL",), "DD": ("DL",), "TR": ("TABLE",), "TD": ("TABLE",), "TH": ("TABLE",)}
SCOPE = ("TABLE", "TD", "TH")


def scope(tag: str) -> tuple[str, ...]:
    """Open elements through which a tag ends nothing."""
    return () if tag == "TABLE" else SCOPES.get(tag, SCOPE)


def _cut(stack: list[str], tag: str, start: bool) -> None:
    """End what a start or end tag ends: the outermost element in its scope that it ends by rule, or its own."""
    at = None
    for i in range(len(stack) - 1, -1, -1):
        if (tag in ENDED_BY.get(stack[i], ())) if start else (stack[i] == tag):
            at = i
            if not start:
                break
        elif stack[i] in scope(tag):
            break
    if at is not None:
        del stack[at:]


def _match(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    positions = table.column("pos").to_pylist()
    stack, open_rows, depth, end = [], [], [], [None] * len(positions)
    for row, (kind, tag) in enumerate(zip(table.column("kind").to_pylist(), table.column("tag").to_pylist(), strict=True)):
        if tag is not None:
            _cut(stack, tag, kind == "start")
        while len(open_rows) > len(stack):
            end[open_rows.pop()] = positions[row]
        depth.append(len(stack))
        if tag is not None and kind == "start":
            stack.append(tag)
            open_rows.append(row)
    return pa.table([table.column("doc_id"), table.column("pos"), pa.array(depth, pa.int32()), pa.array(end, table.column("pos").type)],
                    names=["doc_id", "pos", "depth", "end_pos"])


def matched_tags(tags: DataFrame) -> DataFrame:
    """``(doc_id, pos, depth, end_pos)`` of events: the nesting depth, that of a start being its element's own after what it
    ends, and for a start the position of the event that ends its element, null if none does. Events with a null tag are texts.

    Brackets are matched per page, in one pass: end tags end what stands open inside their element, stray ones
    end nothing, and some starts end an open element (``ENDED_BY``).
    """
    types = {c: tags.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}
    return tags.select("doc_id", "pos", "kind", "tag").groupBy("doc_id").applyInArrow(
        _match, f"doc_id {types['doc_id']}, pos {types['pos']}, depth int, end_pos {types['pos']}")


def _depths(events: DataFrame, tags) -> DataFrame:
    """Events with their nesting depth over ``tags`` (see ``matched_tags``)."""
    sel = F.col("tag").isin(*tags) & ~F.col("tag").isin(*VOID_TAGS) & F.col("kind").isin("start", "end")
    depth = matched_tags(events.select("doc_id", "pos", "kind", F.when(sel, F.col("tag")).alias("tag"))).drop("end_pos")
    return events.withColumn("_sel", F.coalesce(sel, F.lit(False))).join(depth, ["doc_id", "pos"])


def open_elements(elements: DataFrame, probes: DataFrame, value_col: str) -> DataFrame:
    """For probes (doc_id, probe_id, pos, depth) return (doc_id, probe_id, k, value)
    for the element open at each depth k < depth; elements are
    (doc_id, pos, depth, value)."""
    ks = F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>"))
    p = probes.select("doc_id", "probe_id", "pos", F.explode(ks).alias("k"))
    # element values are wrapped in a struct so that only probe rows are null:
    # an element whose own value is null still closes off earlier siblings
    vtype = "struct<x:" + elements.schema[value_col].dataType.simpleString() + ">"
    rows = (p.select("doc_id", "pos", "k", "probe_id", F.lit(None).cast(vtype).alias("v"))
            .unionByName(elements.select("doc_id", "pos", F.col("depth").alias("k"),
                                         F.lit(None).cast("long").alias("probe_id"),
                                         F.struct(F.col(value_col).alias("x")).alias("v"))))
    w = Window.partitionBy("doc_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    got = rows.select("doc_id", "probe_id", "k", F.last("v", ignorenulls=True).over(w).getField("x").alias("value"))
    return got.where(F.col("probe_id").isNotNull() & F.col("value").isNotNull())


def _block_probes(events: DataFrame, blocks_with_owner: DataFrame, depth_events: DataFrame) -> DataFrame:
    """First non-blank text event of each block, with its depth."""
    eb = event_blocks(events, blocks_with_owner)
    first = (eb.where(F.regexp_replace("text", JAVA_WHITESPACE, "") != "")
             .groupBy("doc_id", "block_idx").agg(F.min("pos").alias("pos")))
    return first.join(depth_events.select("doc_id", "pos", "depth"), ["doc_id", "pos"]).select(
        "doc_id", F.col("block_idx").cast("long").alias("probe_id"), "pos", "depth")


def _own_markup_labels(tag, attrs):
    cls = F.trim(F.regexp_replace(F.coalesce(attr(attrs, "class"), F.lit("")), "[0-9]+", "#"))
    ident = F.regexp_replace(F.coalesce(attr(attrs, "id"), F.lit("")), "[0-9]+", "#")
    parts = F.split(cls, "[ ]+")
    labels = F.concat(
        F.array(F.concat(F.lit(MARKUP_PREFIX), tag)),
        F.when(cls != "", F.array(F.concat(F.lit(MARKUP_PREFIX + "."), F.regexp_replace(cls, " ", ".")))
               ).otherwise(F.array().cast("array<string>")),
        F.when((cls != "") & (F.size(parts) > 1),
               F.transform(parts, lambda s: F.concat(F.lit(MARKUP_PREFIX + "."), s))).otherwise(
            F.array().cast("array<string>")),
        F.when(ident != "", F.array(F.concat(F.lit(MARKUP_PREFIX + "#"), ident))).otherwise(
            F.array().cast("array<string>")))
    return labels


def markup_labels(events: DataFrame, blocks_with_owner: DataFrame, tags=None) -> DataFrame:
    """Blocks (with owner) plus markup labels of the elements open at
    the block's first text: each element's own labels (``<TAG``, ``<.class``,
    ``<#id``) and, for every ancestor label ``an``, ``an`` and ``an + ' ' + l``."""
    if tags is None:
        skip = set(DEFAULT_TAG_ACTIONS.no_boundary()) | set(DEFAULT_TAG_ACTIONS.ignorable) | {"HTML", "BODY", "HEAD"}
        tags = [t for t in ("DIV", "P", "UL", "OL", "LI", "TABLE", "TR", "TD", "TH", "SECTION", "ARTICLE", "NAV",
                            "HEADER", "FOOTER", "ASIDE", "MAIN", "H1", "H2", "H3", "H4", "H5", "H6", "BLOCKQUOTE",
                            "PRE", "FORM", "DL", "DT", "DD", "FIGURE", "SPAN") if t not in skip]
    d = _depths(events, tags)
    elems = d.where(F.col("_sel") & (F.col("kind") == "start")).select(
        "doc_id", "pos", "depth", _own_markup_labels(F.col("tag"), F.col("attrs")).alias("own"))
    # ancestors of every element
    anc = open_elements(elems, elems.select("doc_id", F.col("pos").alias("probe_id"), "pos", "depth"), "own")
    anc = anc.groupBy("doc_id", "probe_id").agg(F.array_distinct(F.flatten(F.collect_list("value"))).alias("anc"))
    lwa = elems.join(anc.withColumnRenamed("probe_id", "pos"), ["doc_id", "pos"], "left").select(
        "doc_id", "pos", "depth",
        F.array_distinct(F.concat(
            F.flatten(F.transform(F.coalesce("anc", F.array().cast("array<string>")), lambda an: F.flatten(
                F.transform("own", lambda l: F.array(an, F.concat(an, F.lit(" "), l)))))),
            F.col("own"))).alias("lwa"))
    probes = _block_probes(events, blocks_with_owner, d)
    per_block = open_elements(lwa, probes, "lwa").groupBy("doc_id", "probe_id").agg(
        F.array_distinct(F.flatten(F.collect_list("value"))).alias("mk"))
    out = blocks_with_owner.join(per_block.withColumnRenamed("probe_id", "block_idx"), ["doc_id", "block_idx"], "left")
    return out.withColumn("labels", F.array_sort(F.array_union(
        "labels", F.coalesce("mk", F.array().cast("array<string>"))))).drop("mk")


def font_size_labels(events: DataFrame, blocks_with_owner: DataFrame) -> DataFrame:
    """Label ``font-N`` from the innermost FONT with a size open at the
    block's first text; ``+N``/``-N`` are relative to the size of the enclosing sized FONT
    (default 3), which may itself be relative."""
    d = _depths(events, ("FONT",))
    size = attr(F.col("attrs"), "size")
    m_rel = F.regexp_extract(size, r"^([\+\-]?)([0-9])$", 1)
    m_val = F.regexp_extract(size, r"^([\+\-]?)([0-9])$", 2)
    fonts = d.where(F.col("_sel") & (F.col("kind") == "start")).select(
        "doc_id", "pos", "depth", F.when(m_val != "", F.struct(m_rel.alias("rel"), m_val.cast("int").alias("val")))
        .alias("spec"))
    # the sized fonts on the path to a font: an absolute size starts anew, a relative one adds to what encloses it
    around = open_elements(fonts, fonts.select("doc_id", F.col("pos").alias("probe_id"), "pos", "depth"), "spec")
    path = around.groupBy("doc_id", F.col("probe_id").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("k", "value"))).alias("path"))
    step = lambda size, s: F.when(s["rel"] == "", s["val"]).otherwise(
        size + F.when(s["rel"] == "+", s["val"]).otherwise(-s["val"]))
    above = F.transform(F.coalesce("path", F.array().cast(path.schema["path"].dataType)), lambda x: x["value"])
    eff = fonts.join(path, ["doc_id", "pos"], "left").select(
        "doc_id", "pos", "depth", F.when(F.col("spec").isNotNull(), F.aggregate(
            F.concat(above, F.array("spec")), F.lit(DEFAULT_FONT_SIZE), step)).alias("size"))
    probes = _block_probes(events, blocks_with_owner, d)
    got = open_elements(eff, probes, "size")
    w2 = Window.partitionBy("doc_id", "probe_id").orderBy(F.col("k").desc())
    innermost = got.withColumn("_r", F.row_number().over(w2)).where("_r = 1").select(
        "doc_id", F.col("probe_id").alias("block_idx"), F.concat(F.lit("font-"), F.col("value")).alias("fl"))
    out = blocks_with_owner.join(innermost, ["doc_id", "block_idx"], "left")
    return out.withColumn("labels", F.when(F.col("fl").isNotNull(), F.array_sort(F.array_union(
        "labels", F.array("fl")))).otherwise(F.col("labels"))).drop("fl")
