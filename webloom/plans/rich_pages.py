"""Queries and SQL of the rules that the plain pages never meet: pages with lists after paragraphs, images, a long
heading and comment markers at the end of the article. Each query's rule changes rows (``tests/test_plans.py``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import classifiers as C
from webloom.operators import fusion as G
from webloom.plans import oracle_blocks as OB
from webloom.plans.catalog import _owned as _owned_of
from webloom.plans.catalog import _pages, register
from webloom.plans.oracles import BLOCKS, ORACLES as PLAIN

#: What is replaced in every page, in order.
RICH = (
    ("</p>", '</p><ul><li>a plain list item without links</li><li>and one more of them</li></ul>'
             '<img src="/pic.png" width="40" height="30" alt="a picture"><noscript><img src="/hidden.png"></noscript>'),
    ("</article>", "<h2>a heading of more words than any short block may have so that it counts as content by its own "
                   "length of words alone</h2><p>Comments (12) of our readers</p><p>Have your say here, add your comment below "
                   "and read what all the others had to say about this one before you</p><p>3 users responded in this post</p>"
                   "<h3>the last heading of this page has quite as many words as the first one had so that it also counts as "
                   "content</h3><p><a href=\"/next\">next page</a></p></article>"),
)
ORACLES: dict[str, str] = {}
_HTML = "html"
for _old, _new in RICH:
    _HTML = f"replace({_HTML}, {OB.q(_old)}, {OB.q(_new)})"


def _on_rich_pages(sql: str) -> str:
    return sql.replace("FROM pages", f"FROM (SELECT page_id, url, {_HTML} AS html FROM pages)")


def rich_pages(spark, sf):
    html = F.col("html")
    for old, new in RICH:
        html = F.replace(html, F.lit(old), F.lit(new))
    return _pages(spark, sf).withColumn("html", html)


def _owned(spark, sf, twice=False):
    return _owned_of(spark, sf, rich_pages(spark, sf), twice)


def _f5f1(blocks):
    return C.num_words_rules(C.end_markers(blocks))


#: Per rule: what prepares the blocks, the rule, and the SQL steps of both.
RULES = {
    "end_markers": (lambda b: b, C.end_markers, [OB.f5]),
    "ignore_after_end": (_f5f1, lambda b: C.ignore_after_end(b, 60), [OB.f5, OB.f1, OB.f6]),
    "ignore_after_end_reverse": (_f5f1, C.ignore_after_end_reverse, [OB.f5, OB.f1, OB.f7]),
    "label_to_boilerplate": (lambda b: C.mark_all_content(C.ignore_after_end_reverse(_f5f1(b))), C.label_to_boilerplate,
                             [OB.f5, OB.f1, OB.f7, OB.f14, OB.f13]),
    "list_at_end": (lambda b: C.keep_largest_block(C.num_words_rules(b), True, 0), C.list_at_end,
                    [OB.f1, lambda s: OB.f21(s, True, 0), OB.f24]),
    "trailing_headline": (C.num_words_rules, C.trailing_headline, [OB.f1, OB.f25]),
}


def before_and_after(blocks, name: str):
    """Blocks before and after a rule."""
    prepare, rule, _ = RULES[name]
    before = prepare(blocks)
    return before, rule(before)


def _register() -> None:
    for name, (_, _, steps) in RULES.items():
        def q(spark, sf, name=name):
            return before_and_after(_owned(spark, sf)[1].drop("owner"), name)[1].select(*C.BLOCK_COLUMNS)
        q.__doc__ = f"``{name}`` on pages that it applies to."
        register(f"{name}_rich_pages")(q)
        ORACLES[f"{name}_rich_pages"] = _on_rich_pages(OB.chain(BLOCKS, *steps))


_register()


@register("label_fusion_of_markup")
def q_label_fusion_of_markup(spark, sf):
    """G3 on blocks with markup labels: neighbours of equal markup merge, others don't."""
    from webloom.operators.markup import markup_labels
    ev, bo, _ = _owned(spark, sf)
    return G.label_fusion(markup_labels(ev, bo).drop("owner")).select(*C.BLOCK_COLUMNS)


ORACLES["label_fusion_of_markup"] = _on_rich_pages(OB.chain(
    PLAIN["markup_labels"].replace(f"SELECT {OB.COLS} FROM (", f"SELECT {OB.COLS}, members FROM ("), OB.g3))


@register("content_images_rich_pages")
def q_content_images_rich_pages(spark, sf):
    """Images after paragraphs of the article, ranked by area; hidden ones aside."""
    from webloom.operators.html_extras import content_images, rank_images
    from webloom.plans.extractors import article
    ev, bo, docs = _owned(spark, sf, twice=True)
    return rank_images(content_images(ev, article(bo.drop("owner"), docs), bo))


ORACLES["content_images_rich_pages"] = _on_rich_pages(PLAIN["content_images"])
