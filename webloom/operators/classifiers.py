"""Block classifiers and filters (F1-F27) as window expressions over ``blocks``.

Every function maps blocks -> blocks with the same schema. Neighbour rules
are ``lag``/``lead``; sequential scans are running aggregates; "first/last
such block" is a conditional ``min``/``max`` over the document. All windows
are ``PARTITION BY doc_id ORDER BY block_idx``: blocks come out of
``text_blocks`` already hash-partitioned by ``doc_id``, so no rule shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.tokens import java_trim

# Label names.
TITLE = "TITLE"
ARTICLE_METADATA = "ARTICLE_METADATA"
INDICATES_END_OF_TEXT = "INDICATES_END_OF_TEXT"
MIGHT_BE_CONTENT = "MIGHT_BE_CONTENT"
VERY_LIKELY_CONTENT = "VERY_LIKELY_CONTENT"
STRICTLY_NOT_CONTENT = "STRICTLY_NOT_CONTENT"
HR = "HR"
LI = "LI"
HEADING = "HEADING"
H1 = "H1"
H2 = "H2"
H3 = "H3"
MARKUP_PREFIX = "<"


# Thresholds of the rules.
LINK_DENSITY_LOW = 0.333333
LINK_DENSITY_PREV = 0.555556
FULLTEXT_MIN_DENSITY = 9

# End-of-text markers (lower-cased block text).
END_STARTS = ("comments", "© reuters", "please rate this", "post a comment")
END_NUMBER_STARTS = (" comments", " users responded in")
END_CONTAINS = ("what you think...", "add your comment", "add comment", "reader views", "have your say",
                "reader comments", "rätta artikeln")
END_EQUALS = ("thanks for your comments - this feedback is now closed",)

# date/byline patterns of short metadata blocks.
METADATA_PATTERNS = (
    r"^[0-9 \,\./]*\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|May|June|July"
    r"|August|September|October|November|December)?\b[0-9 \,\:apm\./]*([CPSDMGET]{2,3})?$",
    r"^[Bb]y ",
)

BLOCK_COLUMNS = ("doc_id", "block_idx", "text", "num_words", "num_anchor_words", "num_words_wrapped",
                 "num_wrapped_lines", "text_density", "link_density", "offset_start", "offset_end", "tag_level",
                 "labels", "is_content")


def w_doc():
    return Window.partitionBy("doc_id").orderBy("block_idx")


def w_upto():
    return w_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def w_all():
    return Window.partitionBy("doc_id")


def has(label: str) -> Column:
    return F.array_contains(F.col("labels"), label)


def add_label(label: str, cond: Column | None = None) -> Column:
    added = F.array_sort(F.array_union(F.col("labels"), F.array(F.lit(label))))
    return added if cond is None else F.when(cond, added).otherwise(F.col("labels"))


# Optional columns carried through every rule: members = original block ids
# contained in a (fused) block.
EXTRA_COLUMNS = ("members",)


def _out(df: DataFrame) -> DataFrame:
    return df.select(*BLOCK_COLUMNS, *[c for c in EXTRA_COLUMNS if c in df.columns])


def fulltext_words() -> Column:
    return F.when(F.col("text_density") >= FULLTEXT_MIN_DENSITY, F.col("num_words")).otherwise(0)


def _neighbours(df: DataFrame) -> DataFrame:
    """prev/next values; outside the list an empty block (0 words, densities 0)."""
    w = w_doc()
    return df.select(
        "*",
        F.coalesce(F.lag("link_density").over(w), F.lit(0.0)).alias("p_ld"),
        F.coalesce(F.lag("num_words").over(w), F.lit(0)).alias("p_w"),
        F.coalesce(F.lag("text_density").over(w), F.lit(0.0)).alias("p_td"),
        F.coalesce(F.lead("link_density").over(w), F.lit(0.0)).alias("n_ld"),
        F.coalesce(F.lead("num_words").over(w), F.lit(0)).alias("n_w"),
        F.coalesce(F.lead("text_density").over(w), F.lit(0.0)).alias("n_td"))


# ------------------------------------------------------------ neighbour rules

def num_words_rules(blocks: DataFrame) -> DataFrame:
    """F1."""
    n = _neighbours(blocks)
    ld, w = F.col("link_density"), F.col("num_words")
    content = (F.when(ld > LINK_DENSITY_LOW, F.lit(False))
               .when(F.col("p_ld") <= LINK_DENSITY_PREV,
                     F.when(w > 16, True).when(F.col("n_w") > 15, True).otherwise(F.col("p_w") > 4))
               .otherwise(F.when(w > 40, True).otherwise(F.col("n_w") > 17)))
    return _out(n.withColumn("is_content", content))


def density_rules(blocks: DataFrame) -> DataFrame:
    """F2."""
    n = _neighbours(blocks)
    ld, td = F.col("link_density"), F.col("text_density")
    content = (F.when(ld > LINK_DENSITY_LOW, F.lit(False))
               .when(F.col("p_ld") <= LINK_DENSITY_PREV,
                     F.when(td <= 9, F.when(F.col("n_td") > 10, True).otherwise(F.col("p_td") > 4))
                     .otherwise(F.col("n_td") != 0))
               .otherwise(F.col("n_td") > 11))
    return _out(n.withColumn("is_content", content))


def canola_rules(blocks: DataFrame) -> DataFrame:
    """F3."""
    n = _neighbours(blocks)
    ld, w, nw, nld, pld, pw = (F.col(c) for c in ("link_density", "num_words", "n_w", "n_ld", "p_ld", "p_w"))
    content = ((ld > 0) & (nw > 11)) | (w > 19) | ((nw > 6) & (nld == 0) & (pld == 0) & ((w > 6) | (pw > 7) | (nw > 19)))
    return _out(n.withColumn("is_content", content))


# ------------------------------------------------------------ per-block rules

def end_markers(blocks: DataFrame) -> DataFrame:
    """label INDICATES_END_OF_TEXT on comment-section markers."""
    t = java_trim(F.col("text"))
    lc = F.lower(t)
    num_start = F.lit(False)
    for s in END_NUMBER_STARTS:
        num_start = num_start | lc.rlike("^[0-9]+" + s)
    long_hit = F.lit(False)
    for s in END_STARTS:
        long_hit = long_hit | lc.startswith(s)
    for s in END_CONTAINS:
        long_hit = long_hit | lc.contains(s)
    for s in END_EQUALS:
        long_hit = long_hit | (lc == s)
    long_hit = long_hit | num_start
    short = F.col("num_words") < 15
    cond = short & (((F.length(t) >= 8) & long_hit) |
                    ((F.length(t) < 8) & (F.col("link_density") == 1.0) & (t == "Comment")))
    return _out(blocks.withColumn("labels", add_label(INDICATES_END_OF_TEXT, cond)))


def min_fulltext_words(blocks: DataFrame, min_words: int = 30) -> DataFrame:
    """F9."""
    return _out(blocks.withColumn("is_content", F.col("is_content") & (fulltext_words() >= min_words)))


def min_words(blocks: DataFrame, k: int) -> DataFrame:
    """F10."""
    return _out(blocks.withColumn("is_content", F.col("is_content") & (F.col("num_words") >= k)))


def min_clause_words(blocks: DataFrame, min_words: int = 5, accept_without_delimiter: bool = False) -> DataFrame:
    """content stays if one clause has at least ``min_words`` words."""
    cut = F.regexp_replace("text", r"([\p{L}\d])[\,\.\:\;\!\?]+([ \n\r]+|$)", "$1\ue001")
    pieces = F.split(cut, "\ue001")
    n = F.size(pieces)
    clause_ok = lambda p: F.size(F.split(p, r"[ \n\r]+")) >= min_words
    delimited = F.slice(pieces, 1, n - 1)
    ok = F.exists(delimited, clause_ok)
    if accept_without_delimiter:
        ok = ok | clause_ok(F.element_at(pieces, -1))
    return _out(blocks.withColumn("is_content", F.col("is_content") & ok))


def label_to_content(blocks: DataFrame, labels: list[str]) -> DataFrame:
    """F12."""
    hit = F.arrays_overlap(F.col("labels"), F.array(*[F.lit(x) for x in labels]))
    return _out(blocks.withColumn("is_content", F.col("is_content") | hit))


def label_to_boilerplate(blocks: DataFrame, labels: list[str] = (STRICTLY_NOT_CONTENT,)) -> DataFrame:
    """F13."""
    hit = F.arrays_overlap(F.col("labels"), F.array(*[F.lit(x) for x in labels]))
    return _out(blocks.withColumn("is_content", F.col("is_content") & ~hit))


def mark_all_content(blocks: DataFrame) -> DataFrame:
    """F14."""
    return _out(blocks.withColumn("is_content", F.lit(True)))


def mark_all_boilerplate(blocks: DataFrame) -> DataFrame:
    """F15."""
    return _out(blocks.withColumn("is_content", F.lit(False)))


def invert(blocks: DataFrame) -> DataFrame:
    """F16."""
    return _out(blocks.withColumn("is_content", ~F.col("is_content")))


def drop_boilerplate(blocks: DataFrame, keep_title: bool = False) -> DataFrame:
    """remove non-content blocks (optionally keep TITLE blocks)."""
    keep = F.col("is_content") | (has(TITLE) if keep_title else F.lit(False))
    return blocks.where(keep)


def article_metadata(blocks: DataFrame) -> DataFrame:
    """short date/byline blocks become content + ARTICLE_METADATA."""
    hit = F.lit(False)
    for p in METADATA_PATTERNS:
        hit = hit | F.col("text").rlike(p)
    cond = (F.col("num_words") <= 10) & hit
    return _out(blocks.withColumn("is_content", F.col("is_content") | cond)
                .withColumn("labels", add_label(ARTICLE_METADATA, cond)))


# ------------------------------------------------------------ scans over the document

def ignore_after_end(blocks: DataFrame, min_words: int = 60) -> DataFrame:
    """from the first end marker reached after ``min_words`` full-text
    content words, everything is boilerplate."""
    cum = F.sum(F.when(F.col("is_content"), fulltext_words()).otherwise(0)).over(w_upto())
    flagged = blocks.withColumn("_flag", has(INDICATES_END_OF_TEXT) & (cum >= min_words))
    latched = F.max("_flag").over(w_upto())
    return _out(flagged.withColumn("is_content", F.col("is_content") & ~latched))


def ignore_after_end_reverse(blocks: DataFrame, max_words: int = 200) -> DataFrame:
    """scanning from the end, end-marked blocks are strictly not content
    until more than ``max_words`` content words were passed."""
    words = F.when(F.col("is_content") & ~has(INDICATES_END_OF_TEXT), F.col("num_words")).otherwise(0)
    # words of the following blocks = document total - running total (linear, no forward frame)
    after = F.sum(words).over(w_all()) - F.sum(words).over(w_upto())
    hit = has(INDICATES_END_OF_TEXT) & (after <= max_words)
    labels = F.array_sort(F.array_remove(F.array_union("labels", F.array(F.lit(STRICTLY_NOT_CONTENT))),
                                         MIGHT_BE_CONTENT))
    d = blocks.withColumn("_hit", hit)
    return _out(d.withColumn("is_content", F.col("is_content") & ~F.col("_hit"))
                .withColumn("labels", F.when(F.col("_hit"), labels).otherwise(F.col("labels"))))


def keep_largest_fulltext(blocks: DataFrame) -> DataFrame:
    """F8: only the content block with most full-text words stays content."""
    key = F.max(F.when(F.col("is_content"), F.struct(fulltext_words().alias("w"), (-F.col("block_idx")).alias("i"))))
    d = blocks.select("*", key.over(w_all()).alias("_k"), F.count(F.lit(1)).over(w_all()).alias("_n"))
    active = (F.col("_n") >= 2) & F.col("_k").isNotNull()
    largest = F.col("block_idx") == -F.col("_k.i")
    return _out(d.withColumn("is_content", F.when(active, largest).otherwise(F.col("is_content")))
                .withColumn("labels", add_label(MIGHT_BE_CONTENT, active & ~largest)))


def surrounding_to_content(blocks: DataFrame, stride_two: bool = True) -> DataFrame:
    """a non-content block between two content blocks, without links and
    with more than 6 words, becomes content. ``stride_two`` tests only odd
    list positions, as the library's loop does."""
    w = w_doc()
    d = blocks.select("*", (F.row_number().over(w) - 1).alias("_pos"), F.count(F.lit(1)).over(w_all()).alias("_n"),
                      F.lag("is_content").over(w).alias("_pc"), F.lead("is_content").over(w).alias("_nc"))
    cond = (~F.col("is_content") & F.coalesce(F.col("_pc"), F.lit(False)) & F.coalesce(F.col("_nc"), F.lit(False))
            & (F.col("link_density") == 0) & (F.col("num_words") > 6) & (F.col("_n") >= 3))
    if stride_two:
        cond = cond & (F.col("_pos") % 2 == 1)
    return _out(d.withColumn("is_content", F.col("is_content") | cond))


def split_paragraphs(blocks: DataFrame) -> DataFrame:
    """a block with line breaks becomes one block per paragraph (content
    flag and labels kept, counts reset). Blocks are renumbered."""
    paras = F.split(F.col("text"), r"[\n\r]+")
    d = blocks.select("*", F.posexplode(F.when(F.size(paras) >= 2, paras).otherwise(F.array(F.col("text"))))
                      .alias("_p", "_t"), (F.size(paras) >= 2).alias("_split"))
    z = F.lit(0)
    d = d.select(
        "doc_id", "block_idx", "_p",
        F.when(F.col("_split"), F.col("_t")).otherwise(F.col("text")).alias("text"),
        *[F.when(F.col("_split"), z).otherwise(F.col(c)).alias(c) for c in
          ("num_words", "num_anchor_words", "num_words_wrapped")],
        F.when(F.col("_split"), F.lit(1)).otherwise(F.col("num_wrapped_lines")).alias("num_wrapped_lines"),
        F.when(F.col("_split"), F.lit(0.0)).otherwise(F.col("text_density")).alias("text_density"),
        F.when(F.col("_split"), F.lit(0.0)).otherwise(F.col("link_density")).alias("link_density"),
        *[F.when(F.col("_split"), z).otherwise(F.col(c)).alias(c) for c in ("offset_start", "offset_end", "tag_level")],
        "labels", "is_content", *[c for c in EXTRA_COLUMNS if c in blocks.columns])
    w = Window.partitionBy("doc_id").orderBy("block_idx", "_p")
    return _out(d.withColumn("block_idx", (F.row_number().over(w) - 1).cast("int")))


def title_candidates(title: Column) -> Column:
    """Potential titles of a document title (lower case, quotes removed)."""
    t = F.lower(java_trim(F.regexp_replace(F.regexp_replace(title, "\u00a0", " "), "'", "")))

    def jsplit(s: Column, pattern: str) -> Column:
        parts = F.split(s, pattern)
        trailing = F.aggregate(F.reverse(parts), F.struct(F.lit(False).alias("d"), F.lit(0).alias("c")),
                               lambda acc, x: F.when(acc["d"] | (x != ""), F.struct(F.lit(True).alias("d"),
                                                                                    acc["c"].alias("c")))
                               .otherwise(F.struct(F.lit(False).alias("d"), (acc["c"] + 1).alias("c"))))
        kept = F.slice(parts, 1, F.size(parts) - trailing["c"])
        return F.when(s == "", F.array(F.lit(""))).otherwise(kept)

    def nwords(p: Column) -> Column:
        return F.size(jsplit(p, "[\b ]+"))

    def longest(pattern: str) -> Column:
        parts = jsplit(t, pattern)
        init = F.struct(F.lit(0).alias("n"), F.lit("").alias("p"))
        best = F.aggregate(parts, init, lambda acc, p: F.when(
            ~p.contains(".com") & ((nwords(p) > acc["n"]) | (F.length(p) > F.length(acc["p"]))),
            F.struct(nwords(p).alias("n"), p.alias("p"))).otherwise(acc))
        return F.when((F.size(parts) != 1) & (best["p"] != ""), java_trim(best["p"]))

    def parts_min_words(pattern: str, k: int) -> Column:
        parts = jsplit(t, pattern)
        good = F.filter(parts, lambda p: ~p.contains(".com") & (nwords(p) >= k))
        return F.when(F.size(parts) != 1, good).otherwise(F.array().cast("array<string>"))

    singles = [t] + [longest(p) for p in (
        "[ ]*[\\|»|-][ ]*", "[ ]*[\\|»|:][ ]*", "[ ]*[\\|»|:\\(\\)][ ]*", "[ ]*[\\|»|:\\(\\)\\-][ ]*",
        "[ ]*[\\|»|,|:\\(\\)\\-][ ]*", "[ ]*[\\|»|,|:\\(\\)\\-\u00a0][ ]*")] + [
        F.regexp_replace(t, " - [^\\-]+$", ""), F.regexp_replace(t, "^[^\\-]+ - ", "")]
    allc = F.concat(F.array_compact(F.array(*singles)), parts_min_words("[ ]+[\\|][ ]+", 4),
                    parts_min_words("[ ]+[\\-][ ]+", 4))
    return F.when(title.isNull() | (t == ""), F.lit(None)).otherwise(F.array_sort(F.array_distinct(allc)))


def title_match(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """the first block equal to a potential title gets TITLE."""
    cands = docs.select("doc_id", title_candidates(F.col("title")).alias("_cands"))
    d = blocks.join(cands, "doc_id", "left")
    t1 = F.lower(java_trim(F.regexp_replace(F.regexp_replace("text", "\u00a0", " "), "'", "")))
    t2 = java_trim(F.regexp_replace(t1, r"[\?\!\.\-\:]+", ""))
    match = F.coalesce(F.array_contains("_cands", t1) | F.array_contains("_cands", t2), F.lit(False))
    d = d.withColumn("_m", match)
    first = F.min(F.when(F.col("_m"), F.col("block_idx"))).over(w_all())
    return _out(d.withColumn("labels", add_label(TITLE, F.col("block_idx") == first)))


def keep_largest_block(blocks: DataFrame, expand_to_same_level: bool = False, min_words: int = 0) -> DataFrame:
    """the largest content block stays (VERY_LIKELY_CONTENT), others become
    boilerplate (MIGHT_BE_CONTENT); optionally same-level neighbours inside
    the enclosing lower-level blocks with enough words become content too."""
    key = F.max(F.when(F.col("is_content"), F.struct(F.col("num_words").alias("w"), (-F.col("block_idx")).alias("i"))))
    d = blocks.select("*", key.over(w_all()).alias("_k"), F.count(F.lit(1)).over(w_all()).alias("_n"))
    d = d.withColumn("_li", -F.col("_k.i"))
    d = d.withColumn("_lvl", F.max(F.when(F.col("block_idx") == F.col("_li"), F.col("tag_level"))).over(w_all()))
    active = F.col("_n") >= 2
    largest = F.coalesce(F.col("block_idx") == F.col("_li"), F.lit(False))
    content = largest
    if expand_to_same_level:
        lower = F.col("tag_level") < F.col("_lvl")
        prev_lower = F.max(F.when(lower & (F.col("block_idx") < F.col("_li")), F.col("block_idx"))).over(w_all())
        next_lower = F.min(F.when(lower & (F.col("block_idx") > F.col("_li")), F.col("block_idx"))).over(w_all())
        d = d.withColumn("_pl", prev_lower).withColumn("_nl", next_lower)
        in_range = ((F.col("block_idx") > F.coalesce("_pl", F.lit(-1))) &
                    (F.col("block_idx") < F.coalesce("_nl", F.lit(2 ** 31 - 1))))
        content = largest | (F.col("_k").isNotNull() & in_range & (F.col("tag_level") == F.col("_lvl"))
                             & (F.col("num_words") >= min_words))
    labels = F.when(largest, add_label(VERY_LIKELY_CONTENT)).otherwise(add_label(MIGHT_BE_CONTENT))
    return _out(d.withColumn("is_content", F.when(active, content).otherwise(F.col("is_content")))
                .withColumn("labels", F.when(active, labels).otherwise(F.col("labels"))))


def expand_title(blocks: DataFrame) -> DataFrame:
    """MIGHT_BE_CONTENT blocks from the last TITLE block before the first
    content block up to it become content."""
    first_c = F.min(F.when(F.col("is_content"), F.col("block_idx"))).over(w_all())
    d = blocks.withColumn("_fc", first_c)
    title_i = F.max(F.when(has(TITLE) & (F.col("_fc").isNull() | (F.col("block_idx") <= F.col("_fc"))),
                           F.col("block_idx"))).over(w_all())
    d = d.withColumn("_ti", title_i)
    act = (F.col("_ti").isNotNull() & F.col("_fc").isNotNull() & (F.col("_fc") > F.col("_ti"))
           & (F.col("block_idx") >= F.col("_ti")) & (F.col("block_idx") < F.col("_fc")) & has(MIGHT_BE_CONTENT))
    return _out(d.withColumn("is_content", F.col("is_content") | act))


def large_same_level(blocks: DataFrame, min_words: int = 100) -> DataFrame:
    """F23."""
    lvl = F.first(F.when(F.col("is_content") & has(VERY_LIKELY_CONTENT), F.col("tag_level")), ignorenulls=True).over(
        w_doc().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = blocks.withColumn("_lvl", lvl)
    cond = (~F.col("is_content") & (F.col("num_words") >= min_words) & (F.col("tag_level") == F.col("_lvl")))
    return _out(d.withColumn("is_content", F.col("is_content") | F.coalesce(cond, F.lit(False))))


def list_at_end(blocks: DataFrame) -> DataFrame:
    """list items right after the main block, deeper and without links,
    become content; the run ends at the first other block."""
    anchor = F.col("is_content") & has(VERY_LIKELY_CONTENT)
    d = blocks.select("*", anchor.alias("_a"),
                      F.last(F.when(anchor, F.col("tag_level")), ignorenulls=True).over(w_upto()).alias("_al"),
                      F.last(F.when(anchor, F.col("block_idx")), ignorenulls=True).over(w_upto()).alias("_ai"))
    ok = (~F.col("_a") & F.col("_al").isNotNull() & (F.col("tag_level") > F.col("_al")) & has(MIGHT_BE_CONTENT)
          & has(LI) & (F.col("link_density") == 0))
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    d = d.withColumn("_lf", F.max(F.when(~F.col("_a") & ~F.col("_ok"), F.col("block_idx"))).over(w_upto()))
    passed = F.col("_ok") & (F.col("_lf").isNull() | (F.col("_lf") < F.col("_ai")))
    return _out(d.withColumn("is_content", F.col("is_content") | passed))


def trailing_headline(blocks: DataFrame) -> DataFrame:
    """trailing content headings become boilerplate."""
    last_plain = F.max(F.when(F.col("is_content") & ~has(HEADING), F.col("block_idx"))).over(w_all())
    d = blocks.withColumn("_lp", last_plain)
    drop = F.col("is_content") & has(HEADING) & (F.col("_lp").isNull() | (F.col("block_idx") > F.col("_lp")))
    return _out(d.withColumn("is_content", F.col("is_content") & ~drop))


def add_preceding_labels(blocks: DataFrame, prefix: str = "") -> DataFrame:
    """a block gets its predecessor's labels (with a prefix), from list
    position 2 on."""
    w = w_doc()
    d = blocks.select("*", (F.row_number().over(w) - 1).alias("_pos"), F.lag("labels").over(w).alias("_pl"))
    inherited = F.transform(F.coalesce("_pl", F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    new = F.array_sort(F.array_union("labels", inherited))
    return _out(d.withColumn("labels", F.when(F.col("_pos") >= 2, new).otherwise(F.col("labels"))))

