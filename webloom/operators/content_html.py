"""Extracting mode of highlight (H21): a page's main content as balanced HTML.

Elements come from the matched pairs of start and end tags. Pairs and content
texts are laid out as pieces in document order; an element is kept if the
running number of content texts differs between its two pieces, so that
subtrees are never walked. Everything stays keyed by ``doc_id``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.entities import decode_entities
from webloom.functions.tokens import JAVA_WHITESPACE
from webloom.operators.html import VOID_TAGS
from webloom.operators.html_extras import event_blocks, xml_escape
from webloom.operators.markup import matched_tags

ATTRIBUTE = r"([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
#: A whitelist for plain articles: tags and their attributes.
ARTICLE_TAGS = {"p": (), "a": ("href",), "h1": (), "h2": (), "h3": (), "ul": (), "ol": (), "li": (), "b": (), "em": (),
                "article": ("class",)}
#: Where the end tags of elements that nothing ends stand.
PAGE_END = 2 ** 62


def attributes(attrs: Column, allowed: Column | None = None) -> Column:
    """The attributes of a raw attribute string, lower-case and quoted, each after a blank; of a repeated one the first.

    References in values are decoded, then escaped. Without a value it is
    empty. ``allowed`` is an array of names; the others go.
    """
    found = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), 0)
    names = F.transform(found, lambda m: F.lower(F.regexp_extract(m, ATTRIBUTE, 1)))
    values = F.transform(found, lambda m: F.concat(*(F.regexp_extract(m, ATTRIBUTE, i) for i in (2, 3, 4))))
    both = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p, i: F.struct(
        p["n"].alias("n"), p["v"].alias("v"), (F.array_position(names, p["n"]) == i + 1).alias("first")))
    kept = F.filter(both, lambda p: p["first"] if allowed is None else p["first"] & F.array_contains(allowed, p["n"]))
    return F.array_join(F.transform(kept, lambda p: F.concat(
        F.lit(" "), p["n"], F.lit('="'), xml_escape(decode_entities(p["v"])), F.lit('"'))), "")


def _pieces(elements: DataFrame, content: DataFrame, whitelist: dict[str, tuple[str, ...]] | None, pre: str, post: str) -> DataFrame:
    """``(doc_id, at, turn, sub, elem, is_text, piece)``: content texts, and the two tags of each allowed element.

    ``(at, turn, sub)`` is the order: at a position the ends come first, those of inner elements before outer ones.
    """
    name = F.lower(F.col("tag"))
    allowed = None
    if whitelist is not None:
        table = F.create_map(*chain.from_iterable(
            (F.lit(tag.lower()), F.array(*(F.lit(a.lower()) for a in names)).cast("array<string>")) for tag, names in whitelist.items()))
        allowed = F.element_at(table, name)
        elements = elements.filter(name.isin(*(tag.lower() for tag in whitelist)))
    both = elements.select("doc_id", F.explode(F.array(
        F.struct(F.col("pos").cast("long").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sub"), F.col("pos").alias("elem"), F.lit(False).alias("is_text"),
                 F.concat(F.lit("<"), name, attributes(F.coalesce("attrs", F.lit("")), allowed), F.lit(">")).alias("piece")),
        F.struct(F.coalesce(F.col("end_pos").cast("long"), F.lit(PAGE_END)).alias("at"), F.lit(0).alias("turn"), (-F.col("depth")).alias("sub"),
                 F.col("pos").alias("elem"), F.lit(False).alias("is_text"), F.concat(F.lit("</"), name, F.lit(">")).alias("piece")))).alias("x")).select("doc_id", "x.*")
    texts = content.select("doc_id", F.col("pos").cast("long").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sub"), F.col("pos").alias("elem"),
                           F.lit(True).alias("is_text"), F.concat(F.lit(pre), xml_escape(F.col("text")), F.lit(post)).alias("piece"))
    return both.unionByName(texts)


def extract_html(events: DataFrame, final_blocks: DataFrame, blocks_with_owner: DataFrame,
                 whitelist: dict[str, tuple[str, ...]] | None = None, pre: str = "", post: str = "") -> DataFrame:
    """H21, extracting mode: ``(doc_id, html)``, the content texts in their elements, for each page that has events.

    Texts are the non-blank runs of content blocks, escaped, between ``pre``
    and ``post``. ``whitelist`` maps tags to their allowed attributes: other
    tags go, what they hold stays; without it all stay. Elements that hold no
    content text go, and so do void elements. Outer elements around all of the
    rest go while they hold elements first and last. Ends that a page leaves
    out are written. A page without content gives an empty string.
    """
    members = final_blocks.where("is_content").select("doc_id", F.explode("members").alias("block_idx")).distinct()
    content = event_blocks(events, blocks_with_owner).join(members, ["doc_id", "block_idx"], "left_semi").filter(
        F.regexp_replace("text", JAVA_WHITESPACE, "") != "")
    tags = events.filter(F.col("kind").isin("start", "end") & ~F.col("tag").isin(*VOID_TAGS))
    elements = tags.filter("kind = 'start'").join(matched_tags(tags), ["doc_id", "pos"])
    pieces = _pieces(elements, content, whitelist, pre, post)
    page, element = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "elem")
    order = page.orderBy("at", "turn", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = pieces.withColumn("seen", F.sum(F.col("is_text").cast("long")).over(order))
    kept = counted.withColumn("held", F.max("seen").over(element) - F.min("seen").over(element)).filter("is_text or held > 0")
    placed = kept.withColumn("i", F.row_number().over(page.orderBy("at", "turn", "sub"))).withColumn(
        "r", F.count(F.lit(1)).over(page) - F.col("i") + 1)
    inside = F.least(F.min(F.when(F.col("is_text"), F.col("i"))).over(page), F.min(F.when(F.col("is_text"), F.col("r"))).over(page)) - 2
    outer = placed.select("*", inside.alias("inside"), F.min("i").over(element).alias("first"), F.min("r").over(element).alias("last"))
    left = outer.filter("is_text or first <> last or first > inside")
    html = left.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("html"))
    return events.select("doc_id").distinct().join(html, "doc_id", "left").select("doc_id", F.coalesce("html", F.lit("")).alias("html"))
