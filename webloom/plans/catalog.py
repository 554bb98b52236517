"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import wordcount as wc
from webloom.sources.tables import documents, load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- word counts

@register("read_text")
def q_read_text(spark, sf):
    return wc.lines(documents(spark, sf).select("doc_id", "text"))


@register("tokenize_space")
def q_tokenize_space(spark, sf):
    return wc.words(wc.lines(documents(spark, sf).select("doc_id", "text")))


@register("filter_nonempty")
def q_filter_nonempty(spark, sf):
    return wc.nonempty(wc.words(wc.lines(documents(spark, sf).select("doc_id", "text"))))


@register("lowercase")
def q_lowercase(spark, sf):
    return wc.lowercase(wc.words(wc.lines(documents(spark, sf).select("doc_id", "text"))))


@register("word_count")
def q_word_count(spark, sf):
    return wc.word_count(wc.words(wc.lines(documents(spark, sf).select("doc_id", "text"))).select("word"))


@register("top_k_words")
def q_top_k_words(spark, sf):
    return wc.top_words_of_lines(documents(spark, sf).select("doc_id", "text"), 100)


@register("top_k_threshold")
def q_top_k_threshold(spark, sf):
    w = wc.words(wc.lines(documents(spark, sf).select("doc_id", "text"))).select("word")
    return wc.top_k_threshold(w, threshold=5, k=100)


@register("having_count_and_len")
def q_having(spark, sf):
    w = wc.words(wc.lines(documents(spark, sf).select("doc_id", "text"))).select(F.lower("word").alias("word"))
    return wc.word_count(w.where(F.length("word") < 30)).where(F.col("cnt") > 5)


# ---------------------------------------------------------------- HTML -> blocks

def _pages(spark, sf):
    from webloom.sources.tables import pages
    return pages(spark, sf)


def _events(spark, sf):
    from webloom.operators.html import html_events
    return html_events(_pages(spark, sf))


def _blocks(spark, sf):
    from webloom.operators.html import text_blocks
    return text_blocks(_events(spark, sf))


@register("html_events")
def q_html_events(spark, sf):
    return _events(spark, sf)


@register("text_blocks")
def q_text_blocks(spark, sf):
    return _blocks(spark, sf)


@register("title")
def q_title(spark, sf):
    from webloom.operators.html import docs_of, partition_pages
    return docs_of(partition_pages(_pages(spark, sf)))


# ---------------------------------------------------------------- block rules, fusion, extractors

def _bd(spark, sf):
    from webloom.operators.html import docs_of, events_of, partition_pages, text_blocks
    parted = partition_pages(_pages(spark, sf))
    return text_blocks(events_of(parted)), docs_of(parted)


def _rules():
    """name -> function(blocks, docs) -> blocks."""
    from webloom.operators import classifiers as C
    from webloom.operators import fusion as G
    f1 = C.num_words_rules
    f5f1 = lambda b: C.num_words_rules(C.end_markers(b))
    return {
        "num_words_rules": lambda b, d: f1(b),
        "density_rules": lambda b, d: C.density_rules(b),
        "canola_rules": lambda b, d: C.canola_rules(b),
        "end_markers": lambda b, d: C.end_markers(b),
        "ignore_after_end": lambda b, d: C.ignore_after_end(f5f1(b), 60),
        "ignore_after_end_reverse": lambda b, d: C.ignore_after_end_reverse(f5f1(b)),
        "keep_largest_fulltext": lambda b, d: C.keep_largest_fulltext(f1(b)),
        "min_fulltext_words": lambda b, d: C.min_fulltext_words(f1(b), 30),
        "min_words": lambda b, d: C.min_words(C.mark_all_content(b), 5),
        "min_clause_words": lambda b, d: C.min_clause_words(C.mark_all_content(b), 5),
        "label_to_content": lambda b, d: C.label_to_content(C.title_match(b, d), [C.TITLE]),
        "label_to_boilerplate": lambda b, d: C.label_to_boilerplate(C.ignore_after_end_reverse(f5f1(b))),
        "mark_all_content": lambda b, d: C.mark_all_content(b),
        "mark_all_boilerplate": lambda b, d: C.mark_all_boilerplate(f1(b)),
        "invert": lambda b, d: C.invert(f1(b)),
        "drop_boilerplate": lambda b, d: C.drop_boilerplate(f1(C.title_match(b, d)), keep_title=True),
        "surrounding_to_content": lambda b, d: C.surrounding_to_content(f1(b)),
        "split_paragraphs": lambda b, d: C.split_paragraphs(G.proximity_fusion(f1(b))),
        "title_match": lambda b, d: C.title_match(b, d),
        "keep_largest_block": lambda b, d: C.keep_largest_block(f1(b), True, 150),
        "expand_title": lambda b, d: C.expand_title(C.keep_largest_block(f1(C.title_match(b, d)), True, 150)),
        "large_same_level": lambda b, d: C.large_same_level(C.keep_largest_block(f1(b), False, 0)),
        "list_at_end": lambda b, d: C.list_at_end(C.keep_largest_block(f1(b), True, 0)),
        "trailing_headline": lambda b, d: C.trailing_headline(f1(b)),
        "article_metadata": lambda b, d: C.article_metadata(b),
        "add_preceding_labels": lambda b, d: C.add_preceding_labels(b, "^"),
        "proximity_fusion": lambda b, d: G.proximity_fusion(f1(b), 1, False, False),
        "proximity_fusion_content_same_level": lambda b, d: G.proximity_fusion(f1(b), 1, True, True),
        "density_fusion": lambda b, d: G.density_fusion(b),
        "label_fusion": lambda b, d: G.label_fusion(b),
        "content_fusion": lambda b, d: G.content_fusion(C.ignore_after_end_reverse(f5f1(b))),
    }


def _register_rules():
    for name, fn in _rules().items():
        def q(spark, sf, fn=fn):
            b, d = _bd(spark, sf)
            return fn(b, d)
        QUERIES[name] = q


_register_rules()


@register("fulltext_words")
def q_fulltext_words(spark, sf):
    from webloom.operators.classifiers import fulltext_words
    return _blocks(spark, sf).select("doc_id", "block_idx", fulltext_words().alias("fulltext_words"))


def _register_extractors():
    from webloom.plans import extractors as X
    for name in ("article", "article_sentences", "default", "largest_content", "canola", "num_words",
                 "keep_everything", "keep_everything_min_k"):
        def q(spark, sf, name=name):
            b, d = _bd(spark, sf)
            return X.content_text(X.get_extractor(name)(b, d), d)
        QUERIES["extract_" + name] = q


_register_extractors()


@register("page_top_words")
def q_page_top_words(spark, sf):
    """Flagship: article text of every page -> split(" ") -> counts -> top 100."""
    from webloom.plans import extractors as X
    texts = X.extract(_pages(spark, sf), "article")
    words = texts.select(F.explode(F.split("text", " ")).alias("word"))
    return wc.top_k(wc.word_count(words), 100)


# ---------------------------------------------------------------- text cleaning and vectors

def _docs_text(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _text_query(fn):
    def q(spark, sf):
        return _docs_text(spark, sf).select("doc_id", fn(F.col("text")).alias("text"))
    return q


def _register_text():
    from webloom.functions import cleaning as T
    from webloom.functions.fold import ascii_fold
    QUERIES["clean_text"] = lambda spark, sf: T.clean_documents(_docs_text(spark, sf))
    QUERIES["remove_urls"] = _text_query(T.remove_urls)
    QUERIES["remove_numbers"] = _text_query(T.remove_numbers)
    QUERIES["ascii_fold"] = _text_query(ascii_fold)
    QUERIES["strip_symbols"] = _text_query(T.strip_symbols)
    QUERIES["append_newline"] = lambda spark, sf: T.clean_documents(_docs_text(spark, sf)).select(
        "doc_id", T.append_newline(F.col("text")).alias("text"))

    def analyze(spark, sf):
        return _docs_text(spark, sf).select("doc_id", T.analyze(F.col("text")).alias("tokens"))

    def stop(spark, sf):
        return _docs_text(spark, sf).select("doc_id", T.analyze(F.col("text"), stem=False).alias("tokens"))

    def stem(spark, sf):
        from webloom.functions.stem import stem as stem1
        terms = _docs_text(spark, sf).select(F.explode(T.analyze(F.col("text"), stem=False)).alias("term")).distinct()
        return terms.select("term", stem1(F.col("term")).alias("stem"))

    QUERIES["analyze"] = analyze
    QUERIES["stop_words"] = stop
    QUERIES["stem"] = stem


_register_text()


@register("extract_and_clean")
def q_extract_and_clean(spark, sf):
    from webloom.functions.cleaning import clean_documents
    from webloom.plans import extractors as X
    t = X.extract(_pages(spark, sf), "article")
    return clean_documents(t.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def _counts(spark, sf):
    from webloom.operators import vectorize as V
    return V.term_counts(V.corpus_terms(V.cleaned_texts(documents(spark, sf))))


@register("distinct_terms")
def q_distinct_terms(spark, sf):
    from webloom.operators import vectorize as V
    return V.distinct_terms(_counts(spark, sf))


@register("assign_ids")
def q_assign_ids(spark, sf):
    from webloom.operators import vectorize as V
    return V.assign_ids(V.distinct_terms(_counts(spark, sf)))


@register("term_freq")
def q_term_freq(spark, sf):
    from webloom.operators import vectorize as V
    vocab, dt, _ = V.vectorize_documents(documents(spark, sf))
    return dt


@register("doc_vectors")
def q_doc_vectors(spark, sf):
    from webloom.operators import vectorize as V
    _, _, vec = V.vectorize_documents(documents(spark, sf))
    return vec


@register("doc_vectors_stemmed")
def q_doc_vectors_stemmed(spark, sf):
    from webloom.operators import vectorize as V
    _, _, vec = V.vectorize_documents(documents(spark, sf), stem=True)
    return vec


@register("join_vocab")
def q_join_vocab(spark, sf):
    from webloom.operators import vectorize as V
    vocab, dt, _ = V.vectorize_documents(documents(spark, sf))
    return V.occurrences(dt, vocab)


# ---------------------------------------------------------------- topic models

def _lda_corpus(spark, sf):
    from webloom.operators import vectorize as V
    from webloom.sources.tables import discard, materialized
    vocab, dt, _ = V.vectorize_documents(documents(spark, sf), packed=True)
    corpus = materialized(dt, "lda-corpus")
    for table in dt.sources:
        discard(table)
    return vocab, corpus, vocab.count()


@register("lda_fit")
def q_lda_fit(spark, sf):
    """L1: 10 topics, 20 outer x 100 inner iterations; the 10 heaviest terms per topic."""
    from webloom.operators import topics as L
    vocab, dt, v = _lda_corpus(spark, sf)
    lam, _, _ = L.fit_lda_em(dt, v, k=10, last_use=True)
    return L.top_terms(lam, vocab, 10)


@register("lda_em")
def q_lda_em(spark, sf):
    """10 topics, 20 outer x 100 inner iterations (the fit of ``lda_fit``, under its earlier name)."""
    return q_lda_fit(spark, sf)


@register("lda_em_two_iterations")
def q_lda_em_two(spark, sf):
    """The heaviest terms of 10 topics after two EM iterations with the updated Dirichlet parameter between."""
    from webloom.operators import topics as L
    vocab, dt, v = _lda_corpus(spark, sf)
    lam, _, _ = L.fit_lda_em(dt, v, k=10, outer=2, last_use=True)
    return L.top_terms(lam, vocab, 10).withColumn("weight", F.round("weight", 9))


@register("topic_stats")
def q_topic_stats(spark, sf):
    """One E-step from the seeded start, summed per (topic, term) and per topic."""
    import numpy as np

    from webloom.operators import topics as L
    from webloom.sources.tables import discard
    _, dt, v = _lda_corpus(spark, sf)
    blocks = L.doc_blocks(dt, 10)
    discard(dt)
    L.release_shuffles(spark)
    sums = L.e_step(blocks, L.block_needs(blocks, 10), L.term_blocks(spark, 10, v), np.ones(10), np.full(10, L.ALPHA0), 10, v)
    return L.sum_rows(sums, 10).withColumn("value", F.round("value", 6))


@register("normalize_topics")
def q_normalize_topics(spark, sf):
    """Topics after one EM iteration, long form, each topic summing to 1."""
    from webloom.operators import topics as L
    _, dt, v = _lda_corpus(spark, sf)
    lam, _, _ = L.fit_lda_em(dt, v, k=10, outer=1, last_use=True)
    return L.topics_table(lam).withColumn("value", F.round("value", 9))


@register("alpha_newton")
def q_alpha_newton(spark, sf):
    """L4: the Dirichlet parameter after one EM iteration (K rows)."""
    from webloom.operators import topics as L
    _, dt, v = _lda_corpus(spark, sf)
    _, alpha, _ = L.fit_lda_em(dt, v, k=10, outer=1, last_use=True)
    return spark.createDataFrame([(i, round(float(a), 9)) for i, a in enumerate(alpha)], "k int, alpha double")


@register("corpus_size")
def q_corpus_size(spark, sf):
    """A10: number of documents of the vectorized corpus."""
    from webloom.operators import vectorize as V
    return V.corpus_size(V.cleaned_texts(documents(spark, sf)))


# ---------------------------------------------------------------- crawl records, files

def _records(spark, sf):
    from webloom.sources.crawl import RECORD_SEPARATOR, format_warc_records
    recs = format_warc_records(_pages(spark, sf))
    # the same cut the WARC reader makes at the record separator
    return recs.select(F.explode(F.split("value", RECORD_SEPARATOR.replace(".", r"\."))).alias("value"))


def _crawl_files(spark, pages, charset=None, change=lambda records: records):
    """Pages written as crawl files; their folder."""
    import uuid

    from webloom.session import scratch_path
    from webloom.sources.warc_frames import format_records, write_records
    path = scratch_path(spark, f"crawl-{uuid.uuid4().hex}")
    write_records(change(format_records(pages, charset)), path)
    return path


@register("read_warc")
def q_read_warc(spark, sf):
    """Pages written as crawl files and read by length."""
    from webloom.sources.crawl import responses
    from webloom.sources.warc_frames import read_warc_files
    crawl, _, _ = read_warc_files(spark, _crawl_files(spark, load_table(spark, sf, "pages")))
    return responses(crawl).select("trec_id", "url", "record_type", "html")


@register("read_warc_payload_like_records")
def q_read_warc_nested(spark, sf):
    """Pages that hold a record header, or end in blank lines, come back whole."""
    from webloom.sources.warc_frames import read_warc_files
    fake = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(fake), "html")).when(
        F.col("page_id") % 3 == 1, F.concat("html", F.lit("\r\n\r\n\r\n"))).otherwise(F.col("html"))
    pages = load_table(spark, sf, "pages").withColumn("html", html)
    crawl, _, _ = read_warc_files(spark, _crawl_files(spark, pages), range_bytes=1 << 16)
    return crawl.select("trec_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "html")


#: Pages whose characters ISO-8859-1 has, as the web reads it.
_LATIN = r"^[\x00-\x7F\xA0-\xFF]*$"


@register("read_warc_charsets")
def q_read_warc_charsets(spark, sf):
    """Pages in ISO-8859-1 and UTF-16 read like their UTF-8 twins, down to their text blocks."""
    from webloom.operators.html import html_events, text_blocks
    from webloom.sources.warc_frames import read_warc_files
    kind = F.when((F.col("page_id") % 3 == 0) & F.col("html").rlike(_LATIN), "ISO-8859-1").when(
        F.col("page_id") % 3 == 1, "UTF-16").otherwise("UTF-8")
    crawl, _, _ = read_warc_files(spark, _crawl_files(spark, load_table(spark, sf, "pages").withColumn("kind", kind), "kind"))
    page = crawl.select(F.regexp_extract("trec_id", r"(\d+)$", 1).cast("long").alias("page_id"), "charset", "html")
    size = text_blocks(html_events(page)).groupBy("doc_id").agg(F.sum("num_words").cast("long").alias("num_words"))
    return page.join(size, page.page_id == size.doc_id, "left").select(
        "page_id", "charset", F.md5("html").alias("html_md5"), F.coalesce("num_words", F.lit(0).cast("long")).alias("num_words"))


@register("warc_rejects")
def q_warc_rejects(spark, sf):
    """Good records and rejects by reason, of files in which five of seven records are damaged; counted while they are read."""
    from webloom.sources.warc_frames import read_warc_files

    def damage(records):
        text, k = F.col("record").cast("string"), F.col("page_id") % 7
        first = F.regexp_replace
        bad = F.when(k == 0, first(text, r"\AWARC/1.0\r\n", "GARBAGE\r\n")).when(
            k == 1, first(text, r"(?s)\A(.*?)\r\nContent-Length: \d+\r\n\r\n", "$1\r\n\r\n")).when(
            k == 2, first(text, r"(?s)\A(.*?\r\nContent-Length: )\d+\r\n\r\n", "$1many\r\n\r\n")).when(
            k == 3, first(text, r"(?s)\A(.*?\r\nContent-Length: )\d+\r\n\r\n", "$112\r\n\r\n")).when(
            k == 4, first(text, r"\A(WARC/1.0\r\n)WARC-Type: response\r\n", "$1")).otherwise(text)
        return records.withColumn("record", bad.cast("binary"))

    path = _crawl_files(spark, load_table(spark, sf, "pages"), change=damage)
    _, rejects, counts = read_warc_files(spark, path, range_bytes=1 << 16)
    good = spark.createDataFrame([("good", counts["records"])], "reason string, n long")
    return good.unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@register("extract_header_lines")
def q_extract_header_lines(spark, sf):
    """Id and URI header lines of the records."""
    from webloom.sources.crawl import extract_header_lines
    lines = _records(spark, sf).select(F.explode(F.split("value", "\r\n")).alias("value"))
    return extract_header_lines(lines)


def _vector_lines(spark, sf):
    from webloom.operators import vectorize as V
    _, _, vec = V.vectorize_documents(documents(spark, sf))
    return vec


@register("read_sparse_vectors")
def q_read_sparse_vectors(spark, sf):
    """Document vector lines parsed back into (label, term_id, count)."""
    from webloom.operators.vectorize import vector_lines
    from webloom.sources.files import parse_sparse_vectors
    return parse_sparse_vectors(vector_lines(_vector_lines(spark, sf)))


@register("distinct_topic_keys")
def q_distinct_topic_keys(spark, sf):
    """Distinct keys of the first ten 'key:value' entries of '{...}' lines."""
    from webloom.sources.files import distinct_topic_keys
    vec = _vector_lines(spark, sf)
    lines = vec.select(F.concat(F.col("doc_id"), F.lit("\t{"), F.regexp_replace("vector", " ", ","), F.lit("}"))
                       .alias("value"))
    return distinct_topic_keys(lines)


@register("doc_index")
def q_doc_index(spark, sf):
    """P10: dense 0-based index of the vectorized documents in id order."""
    from webloom.operators.vectorize import doc_index
    return doc_index(_vector_lines(spark, sf).select("doc_id"), "doc_id")


# ---------------------------------------------------------------- anchors, images, highlight, stats

def _owned(spark, sf, pages=None, twice=False):
    """Events, owned blocks and titles; blocks that a query reads ``twice``, alone and under its article, are written once."""
    from webloom.operators.html import docs_of, events_of, partition_pages, text_blocks
    from webloom.sources.tables import materialized
    parted = partition_pages(_pages(spark, sf) if pages is None else pages)
    ev = events_of(parted)
    bo = text_blocks(ev, keep_owner=True)
    return ev, materialized(bo, "page-blocks") if twice else bo, docs_of(parted)


@register("anchors")
def q_anchors(spark, sf):
    """Anchor text and href of every <a> element."""
    from webloom.operators.html_extras import anchors
    return anchors(_events(spark, sf))


@register("anchors_in_block")
def q_anchors_in_block(spark, sf):
    """Anchors with the block holding their last text run."""
    from webloom.operators.html_extras import anchors_in_blocks
    ev, bo, _ = _owned(spark, sf)
    return anchors_in_blocks(ev, bo)


@register("content_images")
def q_content_images(spark, sf):
    """Images inside the article content, ranked by area."""
    from webloom.operators.html_extras import content_images, rank_images
    from webloom.plans.extractors import article
    ev, bo, docs = _owned(spark, sf, twice=True)
    final = article(bo.drop("owner"), docs)
    return rank_images(content_images(ev, final, bo))


@register("highlight")
def q_highlight(spark, sf):
    """Pages rebuilt with the article content marked."""
    from webloom.operators.html_extras import highlight
    from webloom.plans.extractors import article
    ev, bo, docs = _owned(spark, sf, twice=True)
    return highlight(ev, article(bo.drop("owner"), docs), bo)


@register("highlight_content_only")
def q_highlight_content_only(spark, sf):
    """Only the marked content text."""
    from webloom.operators.html_extras import highlight
    from webloom.plans.extractors import article
    ev, bo, docs = _owned(spark, sf, twice=True)
    return highlight(ev, article(bo.drop("owner"), docs), bo, only_content=True)


@register("conditional_label")
def q_conditional_label(spark, sf):
    """Label blocks meeting a predicate (here: no links and more than 10 words)."""
    from webloom.operators.html_extras import conditional_label
    b = _blocks(spark, sf)
    return conditional_label(b, (F.col("link_density") == 0) & (F.col("num_words") > 10), "LONG_TEXT")


@register("doc_stats")
def q_doc_stats(spark, sf):
    """Words, blocks and average words per block of every page."""
    from webloom.operators.stats import doc_stats
    return doc_stats(_blocks(spark, sf))


@register("low_quality")
def q_low_quality(spark, sf):
    """Low-quality estimate from the statistics before and after article extraction."""
    from webloom.operators.stats import doc_stats, low_quality
    from webloom.plans.extractors import article
    b, d = _bd(spark, sf)
    return low_quality(doc_stats(b), doc_stats(article(b, d), content_only=True))


@register("markup_labels")
def q_markup_labels(spark, sf):
    """H12 (opt-in): blocks with markup labels of their enclosing elements."""
    from webloom.operators.markup import markup_labels
    ev, bo, _ = _owned(spark, sf)
    return markup_labels(ev, bo).drop("owner", "members")


@register("font_size_labels")
def q_font_size_labels(spark, sf):
    """H13 (opt-in): blocks with font-size labels."""
    from webloom.operators.markup import font_size_labels
    ev, bo, _ = _owned(spark, sf)
    return font_size_labels(ev, bo).drop("owner", "members")


def _replaced(spark, sf, *pairs):
    """Events and owned blocks of pages whose html has strings replaced."""
    from webloom.operators.html import html_events, text_blocks
    html = F.col("html")
    for old, new in pairs:
        html = F.replace(html, F.lit(old), F.lit(new))
    ev = html_events(_pages(spark, sf).withColumn("html", html))
    return ev, text_blocks(ev, keep_owner=True)


@register("markup_labels_unclosed")
def q_markup_labels_unclosed(spark, sf):
    """H12 on pages whose paragraphs and list items have no end tags: siblings don't inherit one another's labels."""
    from webloom.operators.markup import markup_labels
    ev, bo = _replaced(spark, sf, ("</p>", ""), ("</li>", ""), ("<p>", '<p class="x y7">'))
    return markup_labels(ev, bo).drop("owner", "members")


@register("font_size_labels_nested")
def q_font_size_labels_nested(spark, sf):
    """H13 on pages with absolute, relative and unsized fonts in one another."""
    from webloom.operators.markup import font_size_labels
    ev, bo = _replaced(spark, sf, ("<article", '<font size="5"><article'), ("</article>", "</article></font>"),
                       ("<p>", '<font size="+1"><p>'), ("</p>", "</p></font>"),
                       ("<b>", '<font size="-2"><font><b>'), ("</b>", "</b></font></font>"))
    return font_size_labels(ev, bo).drop("owner", "members")


@register("extract_html")
def q_extract_html(spark, sf):
    """H21, extracting mode: the article content of every page as balanced HTML with its elements and attributes."""
    from webloom.operators.content_html import extract_html
    from webloom.plans.extractors import article
    ev, bo, docs = _owned(spark, sf, twice=True)
    return extract_html(ev, article(bo.drop("owner"), docs), bo)


@register("extract_html_whitelist")
def q_extract_html_whitelist(spark, sf):
    """H21, extracting mode with allowed tags and attributes, on pages with open paragraphs, repeated attributes and empty elements."""
    from webloom.operators.content_html import ARTICLE_TAGS, extract_html
    from webloom.plans.extractors import article
    html = F.col("html")
    for old, new in (("</p>", ' see <a title="x > y" HREF="/q?a=1&amp;b=&quot;2" href="/r">this</a> <i></i><br>'), ("</li>", ""),
                     ("<article", "<article class=main id=m")):
        html = F.replace(html, F.lit(old), F.lit(new))
    ev, bo, docs = _owned(spark, sf, _pages(spark, sf).withColumn("html", html), twice=True)
    return extract_html(ev, article(bo.drop("owner"), docs), bo, ARTICLE_TAGS)


# ---------------------------------------------------------------- single-step helpers as queries

@register("strip_tags")
def q_strip_tags(spark, sf):
    """Page text with everything between '<' and '>' removed."""
    from webloom.operators.html import strip_tags
    return _pages(spark, sf).select(F.col("page_id").alias("doc_id"), strip_tags(F.col("html")).alias("text"))


@register("pair_with_one")
def q_pair_with_one(spark, sf):
    """(word, 1) pairs of the space-split lines."""
    w = wc.words(wc.lines(documents(spark, sf).select("doc_id", "text")))
    return w.select("word", F.lit(1).alias("one"))


@register("join_content_text")
def q_join_content_text(spark, sf):
    """Text of all blocks (content and non-content) per page, newline after each."""
    from webloom.operators.classifiers import num_words_rules
    from webloom.plans.extractors import content_text
    b, d = _bd(spark, sf)
    return content_text(num_words_rules(b), d, include_content=True, include_non_content=True)


@register("count_words")
def q_count_words(spark, sf):
    """Word tokens of each block's text (equals the block's num_words)."""
    from webloom.functions.tokens import count_words
    return _blocks(spark, sf).select("doc_id", "block_idx", count_words(F.col("text")).alias("words"))
