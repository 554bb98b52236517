"""Extractors (E1-E9): compositions of block rules, chained with ``transform``.

Each rule sees the previous rule's ``is_content`` and labels. Input blocks
come hash-partitioned by ``doc_id``; the whole chain stays in that
partitioning (the only exchange of a page job is the one in
``html_events``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators import classifiers as C
from webloom.operators import fusion as G
from webloom.operators.html import docs_of, events_of, partition_pages, text_blocks


def article(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """News-article main content."""
    return (blocks
            .transform(C.end_markers)
            .transform(lambda b: C.title_match(b, docs))
            .transform(C.num_words_rules)
            .transform(lambda b: C.ignore_after_end(b, 60))
            .transform(C.trailing_headline)
            .transform(lambda b: G.proximity_fusion(b, 1, False, False))
            .transform(lambda b: C.drop_boilerplate(b, keep_title=True))
            .transform(lambda b: G.proximity_fusion(b, 1, True, True))
            .transform(lambda b: C.keep_largest_block(b, True, 150))
            .transform(C.expand_title)
            .transform(C.large_same_level)
            .transform(C.list_at_end))


def article_sentences(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """E1, then paragraphs split and clause filter."""
    return article(blocks, docs).transform(C.split_paragraphs).transform(C.min_clause_words)


def default(blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E3."""
    return (blocks.transform(G.density_fusion)
            .transform(lambda b: G.proximity_fusion(b, 1, False, False))
            .transform(C.density_rules))


def largest_content(blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E4."""
    return (blocks.transform(C.num_words_rules)
            .transform(lambda b: G.proximity_fusion(b, 1, False, False))
            .transform(lambda b: C.keep_largest_block(b, False, 0)))


def canola(blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E5."""
    return C.canola_rules(blocks)


def num_words(blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E6."""
    return C.num_words_rules(blocks)


def keep_everything(blocks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """E7."""
    return C.mark_all_content(blocks)


def keep_everything_min_k(blocks: DataFrame, docs: DataFrame | None = None, k: int = 5) -> DataFrame:
    """E8."""
    return C.min_words(C.mark_all_content(G.density_fusion(blocks)), k)


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "article": article, "default": default, "largest_content": largest_content, "canola": canola,
    "keep_everything": keep_everything, "article_sentences": article_sentences, "num_words": num_words,
    "keep_everything_min_k": keep_everything_min_k,
}


def get_extractor(name: str) -> Callable[..., DataFrame]:
    """Extractor by name."""
    return EXTRACTORS[name]


def content_text(blocks: DataFrame, docs: DataFrame, include_content: bool = True,
                 include_non_content: bool = False) -> DataFrame:
    """Per document the chosen blocks' text in order, each followed by a
    newline; documents without such blocks give an empty text."""
    keep = (F.col("is_content") & F.lit(include_content)) | (~F.col("is_content") & F.lit(include_non_content))
    texts = (blocks.where(keep).groupBy("doc_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))),
                                           lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text")))
    return docs.join(texts, "doc_id", "left").select(
        "doc_id", "title", F.coalesce("text", F.lit("")).alias("text"))


def extract(pages: DataFrame, extractor: str | Callable[..., DataFrame] = "article",
            id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages -> (doc_id, title, text) with the given extractor."""
    fn = get_extractor(extractor) if isinstance(extractor, str) else extractor
    parted = partition_pages(pages, id_col, html_col)
    docs = docs_of(parted)
    return content_text(fn(text_blocks(events_of(parted)), docs), docs)


def renumber(blocks: DataFrame) -> DataFrame:
    """Dense list positions after filters (block_idx keeps the order only)."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    return blocks.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
