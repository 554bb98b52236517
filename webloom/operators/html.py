"""HTML pages -> event table -> text blocks.

A page is cut into an event table ``events(doc_id, pos, kind, tag, attrs,
text)`` with ``regexp_extract_all`` + ``posexplode``. Every parser counter of
a SAX walk is a running window aggregate over ``(doc_id ORDER BY pos)``, and
a block is one ``groupBy(doc_id, block)``.

Partitioning: pages are hash-partitioned by ``doc_id`` once, *before* the
explode (raw HTML minus comments and script/style bodies crosses the network,
not the exploded events). Every later window and grouping keyed by
``doc_id`` reuses that partitioning, so the whole chain has one exchange;
reading a table bucketed by ``doc_id`` removes it too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.entities import decode_entities
from webloom.functions.tokens import (ANCHOR_END, ANCHOR_START, JAVA_WHITESPACE, SOFT_SPACE, block_counts,
                                      block_tokens, java_trim, spaces_only, trim_spaces)

# a tag ends at the first ">" outside quoted attribute values (possessive: no recursion on long tags)
TOKEN_RE = (r"</?[A-Za-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>|</?[A-Za-z][^>]*>"
            r"|<![^>]*>|<\?[^>]*>|[^<]+|<")
TAG_NAME_RE = r"^</?([A-Za-z][A-Za-z0-9:_-]*)"
ATTRS_RE = r"(?s)^</?[A-Za-z][A-Za-z0-9:_-]*\s*(.*?)\s*/?>$"


# --------------------------------------------------------------------------
# Tag actions (H23). The default tag map of the block library.
#   ignorable (text dropped, block boundary, level change):
#       STYLE SCRIPT OPTION OBJECT EMBED APPLET LINK NOSCRIPT
#   anchor (linked words, whitespace, level change): A
#   body (blocks only inside, boundary, level change): BODY
#   inline, no whitespace, no boundary, no level change:
#       STRIKE U B I EM STRONG SPAN SUP CODE TT SUB VAR FONT
#   inline with whitespace: ABBR ACRONYM
#   block with labels: LI -> LI; H1 -> H1, HEADING; H2 -> H2, HEADING; H3 -> H3, HEADING
#   any other tag: block boundary and level change.
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class TagActions:
    ignorable: tuple = ("STYLE", "SCRIPT", "OPTION", "OBJECT", "EMBED", "APPLET", "LINK", "NOSCRIPT")
    anchor: tuple = ("A",)
    body: tuple = ("BODY",)
    inline_no_space: tuple = ("STRIKE", "U", "B", "I", "EM", "STRONG", "SPAN", "SUP", "CODE", "TT", "SUB", "VAR",
                              "FONT")
    inline_space: tuple = ("ABBR", "ACRONYM")
    labels: dict = field(default_factory=lambda: {"LI": ("LI",), "H1": ("H1", "HEADING"), "H2": ("H2", "HEADING"),
                                                  "H3": ("H3", "HEADING")})

    def chain(self, other: "TagActions") -> "TagActions":
        """Two actions on one tag: flags OR-ed, labels united."""
        labels = {k: tuple(sorted(set(self.labels.get(k, ())) | set(other.labels.get(k, ()))))
                  for k in set(self.labels) | set(other.labels)}
        u = lambda a, b: tuple(sorted(set(a) | set(b)))
        return TagActions(u(self.ignorable, other.ignorable), u(self.anchor, other.anchor), u(self.body, other.body),
                          u(self.inline_no_space, other.inline_no_space), u(self.inline_space, other.inline_space),
                          labels)

    def no_boundary(self) -> tuple:
        return tuple(self.anchor) + tuple(self.inline_no_space) + tuple(self.inline_space)

    def no_level_change(self) -> tuple:
        return tuple(self.inline_no_space) + tuple(self.inline_space)


DEFAULT_TAG_ACTIONS = TagActions()

# HTML facts used to repair unbalanced markup the way an HTML parser would.
VOID_TAGS = ("AREA", "BASE", "BASEFONT", "BR", "COL", "EMBED", "FRAME", "HR", "IMG", "INPUT", "ISINDEX", "KEYGEN",
             "LINK", "META", "PARAM", "SOURCE", "TRACK", "WBR")
_BLOCKISH = ("ADDRESS", "ARTICLE", "ASIDE", "BLOCKQUOTE", "DIV", "DL", "FIELDSET", "FIGURE", "FOOTER", "FORM", "H1",
             "H2", "H3", "H4", "H5", "H6", "HEADER", "HR", "MAIN", "MENU", "NAV", "OL", "P", "PRE", "SECTION", "TABLE",
             "UL", "LI", "DD", "DT")
# Elements whose end tag may be left out: (start tags that close them, end tags that close them).
IMPLIED_END = {
    "P": (_BLOCKISH, ("P", "DIV", "BODY", "HTML", "TD", "TH", "LI", "BLOCKQUOTE", "ARTICLE", "SECTION", "ASIDE",
                      "FOOTER", "HEADER", "NAV", "MAIN", "FORM", "DD", "DT", "FIGURE")),
    "LI": (("LI",), ("LI", "UL", "OL", "MENU", "BODY")),
    "OPTION": (("OPTION", "OPTGROUP"), ("OPTION", "OPTGROUP", "SELECT", "DATALIST", "BODY")),
    "DT": (("DT", "DD"), ("DT", "DD", "DL", "BODY")),
    "DD": (("DT", "DD"), ("DT", "DD", "DL", "BODY")),
    "TD": (("TD", "TH", "TR", "TBODY", "THEAD", "TFOOT"), ("TD", "TH", "TR", "TABLE", "TBODY", "THEAD", "TFOOT", "BODY")),
    "TH": (("TD", "TH", "TR", "TBODY", "THEAD", "TFOOT"), ("TD", "TH", "TR", "TABLE", "TBODY", "THEAD", "TFOOT", "BODY")),
    "TR": (("TR", "TBODY", "THEAD", "TFOOT"), ("TR", "TABLE", "TBODY", "THEAD", "TFOOT", "BODY")),
}



#: Bytes of HTML that a partition of pages holds.
PARTITION_BYTES = 4 << 20


def _w():
    return Window.partitionBy("doc_id").orderBy("pos")


def _w_before():
    return _w().rowsBetween(Window.unboundedPreceding, -1)


def _w_upto():
    return _w().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _w_rev_upto():
    """Running frame in reverse document order: "first at or after" as an
    incremental running aggregate (a forward unbounded frame would be
    re-evaluated for every row)."""
    return Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding,
                                                                                 Window.currentRow)


def _w_all():
    return _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def clean_html(html: Column) -> Column:
    """Drop comments; empty the bodies of script and style (their text may
    hold tag-like strings) but keep the elements, which still cut blocks."""
    h = F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")
    h = F.regexp_replace(h, r"(?is)(<script\b[^>]*>).*?(</script\s*>|$)", "$1</script>")
    return F.regexp_replace(h, r"(?is)(<style\b[^>]*>).*?(</style\s*>|$)", "$1</style>")


def strip_tags(html: Column) -> Column:
    """Everything between ``<`` and ``>`` removed."""
    return F.regexp_replace(html, "<[^>]*>", "")


def head_title(h: Column) -> Column:
    """H4 on cleaned HTML: the first text run of the first TITLE element before
    BODY, entity-decoded, whitespace to spaces, trimmed; null when empty."""
    head = F.regexp_replace(h, r"(?is)<body\b.*", "")
    raw = F.regexp_extract(head, r"(?is)<title(?:\s[^>]*)?>([^<]*)", 1)
    t = java_trim(F.regexp_replace(decode_entities(raw), JAVA_WHITESPACE, " "))
    return F.when(t != "", t)


def page_partitions(pages: DataFrame, html_col: str = "html") -> int:
    """Partitions of a page job, by the bytes of its HTML: the windows over a partition's events sort more than a hundred
    times the memory of its pages, so a task's share must not grow with the table."""
    size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def partition_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                    num_partitions: int | None = None) -> DataFrame:
    """(doc_id, h, title) hash-partitioned by doc_id: the single exchange of a
    page job. Events and titles are both derived from it, so the shuffle is
    shared (exchange reuse) and later doc_id joins need no re-shuffle.

    Of records that share an id (a page crawled again) the one with the
    greatest cleaned HTML is taken, so that pages are never spliced; records
    without id are left out, as no result could name them."""
    # an explicit id filter keeps every branch's plan below the exchange
    # identical (joins infer the same filter), so the shuffle is reused
    # ids keep their own type (numeric page ids, or string record ids such as
    # TREC ids: no hashing, so no collisions)
    pre = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), clean_html(F.col(html_col)).alias("h"))
    pre = pre.repartition(num_partitions or page_partitions(pages, html_col), "doc_id")
    pre = pre.groupBy("doc_id").agg(F.max("h").alias("h"))  # on the same partitioning: no exchange
    return pre.select("doc_id", "h", head_title(F.col("h")).alias("title"))


def events_of(parted: DataFrame) -> DataFrame:
    """H1 from partitioned pages."""
    tok = parted.select("doc_id", F.posexplode(F.regexp_extract_all("h", F.lit(TOKEN_RE), 0)).alias("pos", "tok"))
    kind = (F.when(F.col("tok").rlike("^</[A-Za-z]"), "end")
            .when(F.col("tok").rlike("^<[A-Za-z]"), "start")
            .when(F.col("tok").rlike("^<[!?]"), None)
            .otherwise("text"))
    ev = tok.select("doc_id", "pos", kind.alias("kind"), "tok").where(F.col("kind").isNotNull())
    return ev.select(
        "doc_id", "pos", "kind",
        F.when(F.col("kind") != "text", F.upper(F.regexp_extract("tok", TAG_NAME_RE, 1))).alias("tag"),
        F.when(F.col("kind") == "start", F.regexp_extract("tok", ATTRS_RE, 1)).alias("attrs"),
        F.when(F.col("kind") == "text", decode_entities(F.col("tok"))).alias("text"))


def docs_of(parted: DataFrame) -> DataFrame:
    """docs(doc_id, title) from partitioned pages (no window, no extra exchange)."""
    return parted.select("doc_id", "title")


def html_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                num_partitions: int | None = None) -> DataFrame:
    """H1: events(doc_id, pos, kind, tag, attrs, text); kind in start/end/text.

    Text is entity-decoded; tag names are upper case; comments, doctype and
    processing instructions produce no event.
    """
    return events_of(partition_pages(pages, id_col, html_col, num_partitions))


LIST_TAGS = ("UL", "OL", "MENU")
# Elements that may stand before the body; any other one opens it where a page has no BODY tag.
HEAD_TAGS = ("HTML", "HEAD", "TITLE", "META", "LINK", "BASE", "BASEFONT", "ISINDEX", "STYLE", "SCRIPT", "NOSCRIPT",
             "FRAMESET", "FRAME", "NOFRAMES")


def _li_counts(ev: DataFrame) -> DataFrame:
    """Number of open list items before each event, exact for nested lists.

    Each list depth keeps its own item state (one window over
    (doc_id, list depth)); a new item or the end of its list closes the
    previous open item at that depth. The closes become -1 deltas, so the
    count of open items is a running sum over the document.
    """
    tag, kind = F.col("tag"), F.col("kind")
    is_list = tag.isin(*LIST_TAGS)
    start, end = kind == "start", kind == "end"
    depth = F.coalesce(F.sum(F.when(is_list & start, 1).when(is_list & end, -1)).over(_w_before()), F.lit(0))
    e1 = ev.select("*", depth.alias("_ld0"))
    key = (F.when(F.col("tag") == "LI", F.col("_ld0")).when(is_list & start, F.col("_ld0") + 1)
           .when(is_list & end, F.col("_ld0")))
    mark = F.when((tag == "LI") & start, F.lit(True)).when(((tag == "LI") & end) | is_list, F.lit(False))
    e2 = e1.select("*", key.alias("_lk"), mark.alias("_lm"))
    wk = Window.partitionBy("doc_id", "_lk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.last("_lm", ignorenulls=True).over(wk), F.lit(False)).cast("int")
    delta = (F.when((tag == "LI") & start, 1 - open_before)
             .when(((tag == "LI") & end) | (is_list & end), -open_before).otherwise(0))
    e3 = e2.select("*", delta.alias("_dl"))
    return e3.select(*ev.columns, F.coalesce(F.sum("_dl").over(_w_before()), F.lit(0)).alias("li_count"))


def _stray_ends(ev: DataFrame) -> DataFrame:
    """Marks end tags of which no element is open (``stray``): the running
    start-minus-end count of the tag falls below all it had before."""
    w = Window.partitionBy("doc_id", "tag").orderBy("pos")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1)
    counted = ev.select("*", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run"))
    low = F.least(F.lit(0), F.min("_run").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return counted.select(*ev.columns, ((F.col("kind") == "end") & (F.col("_run") < low)).alias("stray"))


def _running_state(ev: DataFrame, actions: TagActions) -> DataFrame:
    """Parser counters as window aggregates; all "before this event". Stray
    end tags change none of them."""
    ev = _stray_ends(_li_counts(ev))
    tag, kind = F.col("tag"), F.col("kind")
    is_start, is_end = kind == "start", kind == "end"
    void = tag.isin(*VOID_TAGS)
    optional = tag.isin(*IMPLIED_END)
    balanced = ~void & ~optional

    def delta(cond: Column) -> Column:
        return (F.when(cond & balanced & is_start, 1)
                .when(cond & balanced & is_end & ~F.col("stray"), -1).otherwise(0))

    cols = {}
    for t, (start_closers, end_closers) in IMPLIED_END.items():
        mark = (F.when(is_start & (tag == t), F.lit(True))
                .when((is_start & tag.isin(*start_closers)) | (is_end & tag.isin(*end_closers)), F.lit(False)))
        cols[f"open_{t}"] = F.coalesce(F.last(mark, ignorenulls=True).over(_w_before()), F.lit(False))
    cols["open_LI"] = F.col("li_count") > 0  # list items: exact nesting count

    level_changing = ~tag.isin(*actions.no_level_change())
    cols["lvl_sum"] = F.coalesce(F.sum(delta(level_changing)).over(_w_before()), F.lit(0))
    ign_balanced = [t for t in actions.ignorable if t not in IMPLIED_END]
    cols["ign_sum"] = F.coalesce(F.sum(delta(tag.isin(*ign_balanced))).over(_w_before()), F.lit(0))
    cols["body_sum"] = F.coalesce(F.sum(delta(tag.isin(*actions.body))).over(_w_before()), F.lit(0))
    a_mark = F.when(tag.isin(*actions.anchor) & is_start, F.lit(True)).when(tag.isin(*actions.anchor) & is_end,
                                                                            F.lit(False))
    cols["in_a"] = F.coalesce(F.last(a_mark, ignorenulls=True).over(_w_before()), F.lit(False))
    label_tags = [t for t in actions.labels if t not in IMPLIED_END]
    for t in label_tags:
        cols[f"lab_{t}"] = F.coalesce(F.sum(delta(tag == t)).over(_w_before()), F.lit(0))
    cols["title_sum"] = F.coalesce(F.sum(delta(tag == "TITLE")).over(_w_before()), F.lit(0))
    is_trigger = (kind != "text") & ~tag.isin(*actions.no_boundary())
    cols["grp"] = F.sum(F.when(is_trigger, 1).otherwise(0)).over(_w_upto())
    return ev.select("*", is_trigger.alias("is_trigger"), *[c.alias(k) for k, c in cols.items()])


def _label_array(actions: TagActions) -> Column:
    parts = []
    for t, labs in sorted(actions.labels.items()):
        open_col = F.col(f"open_{t}") if t in IMPLIED_END else (F.col(f"lab_{t}") > 0)
        parts += [F.when(open_col, F.lit(lab)) for lab in labs]
    if not parts:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))


def text_blocks(events: DataFrame, actions: TagActions = DEFAULT_TAG_ACTIONS, keep_owner: bool = False) -> DataFrame:
    """Blocks of a page (D5 schema), in document order, ``is_content`` false.

    ``keep_owner`` adds ``owner``: the block-boundary count of the events that
    form the block (to map events to blocks) and ``members`` = [block_idx].
    """
    t_norm = spaces_only(F.col("text"))
    # once per event, below the windows, whose other expressions then are cheap
    events = events.withColumn("text", t_norm).withColumn("core", trim_spaces(F.col("text")))
    st = _running_state(events, actions)
    tag, kind, t_norm, core = F.col("tag"), F.col("kind"), F.col("text"), F.col("core")
    level = F.col("lvl_sum") + sum((F.col("li_count") if t == "LI" else F.col(f"open_{t}").cast("int") for t in IMPLIED_END
                                   if t not in actions.no_level_change()), F.lit(0))
    ignorable = (F.col("ign_sum") > 0) | (F.col("open_OPTION") if "OPTION" in actions.ignorable else F.lit(False))
    is_text = kind == "text"
    # a page without a BODY tag: the first body element or text opens the body
    opens = (((kind == "start") & ~tag.isin(*HEAD_TAGS, *actions.body))
             | (is_text & ~ignorable & (F.col("title_sum") == 0) & (core != "")))
    has_body = F.max((kind == "start") & tag.isin(*actions.body)).over(_w_all())
    st = st.select("*", (~has_body & F.max(opens).over(_w_upto())).alias("implied_body"))
    level = level + F.col("implied_body").cast("int")
    soft = F.lit(SOFT_SPACE)
    text_piece = (F.when(~is_text | ignorable, F.lit(None))
                  .when(core == "", soft)
                  .otherwise(F.concat(F.when(t_norm.startswith(" "), soft).otherwise(""), core,
                                      F.when(t_norm.endswith(" "), soft).otherwise(""))))
    is_anchor_ev = tag.isin(*actions.anchor) & (kind != "text")
    ws_tag = (is_anchor_ev & ~ignorable) | (tag.isin(*actions.inline_space) & (kind != "text"))
    text_piece = F.when(ws_tag, soft).otherwise(text_piece)
    token_piece = (F.when(is_anchor_ev & ~ignorable,
                          F.concat(soft, F.when(kind == "start", F.lit(ANCHOR_START)).otherwise(F.lit(ANCHOR_END)), soft))
                   .otherwise(text_piece))
    is_core = is_text & ~ignorable & (core != "")
    is_exec = is_text | (kind == "end") | ((kind == "start") & tag.isin(*actions.body))
    ev = st.select(
        "doc_id", "pos", "grp", "is_trigger", "in_a",
        F.when(F.col("is_trigger"), F.col("grp") - 1).otherwise(F.col("grp")).alias("owner"),
        ((F.col("body_sum") > 0) | F.col("implied_body")).alias("in_body"),
        text_piece.alias("tp"), token_piece.alias("kp"),
        F.when(is_core, level).alias("core_level"),
        F.when(is_exec, _label_array(actions)).alias("exec_labels"))
    ev = ev.select(
        "*",
        F.last("exec_labels", ignorenulls=True).over(_w_rev_upto()).alias("labels_at"),
        F.first("core_level", ignorenulls=True).over(_w_all()).alias("doc_level"))
    piece = F.col("tp").isNotNull()
    pieces = F.sort_array(F.collect_list(F.when(piece, F.struct("pos", "tp", "kp"))))
    tbuf, kbuf = (F.array_join(pieces[c], "") for c in ("tp", "kp"))
    a0 = F.min_by("in_a", F.when(piece, F.col("pos")))
    in_body = F.max(F.when(piece, F.col("in_body")))
    # texts and counts are results of the aggregate, so that a filter on them does not work them out a second time
    grouped = ev.groupBy("doc_id", "owner").agg(
        F.when(in_body, java_trim(F.regexp_replace(tbuf, SOFT_SPACE + "+", " "))).alias("text"),
        F.when(in_body, block_counts(F.filter(block_tokens(F.regexp_replace(kbuf, SOFT_SPACE + "+", " ")), lambda t: t != ""),
                                     F.coalesce(a0, F.lit(False)))).alias("c"),
        F.min_by("core_level", F.when(F.col("core_level").isNotNull(), F.col("pos"))).alias("level0"),
        F.max(F.when(F.col("is_trigger"), F.col("labels_at"))).alias("labels"),
        F.first("doc_level").alias("doc_level"))
    made = grouped.where(F.col("c.num_tokens") > 0)
    w_blk = Window.partitionBy("doc_id").orderBy("owner")
    blocks = made.select(
        "doc_id", (F.row_number().over(w_blk) - 1).cast("int").alias("block_idx"), "text",
        F.col("c.num_words").alias("num_words"), F.col("c.num_anchor_words").alias("num_anchor_words"),
        F.col("c.num_words_wrapped").alias("num_words_wrapped"),
        F.col("c.num_wrapped_lines").alias("num_wrapped_lines"),
        "level0", "doc_level", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "owner")
    extra = [F.col("owner"), F.array(F.col("block_idx")).alias("members")] if keep_owner else []
    return blocks.select(
        "doc_id", "block_idx", "text", "num_words", "num_anchor_words", "num_words_wrapped", "num_wrapped_lines",
        densities_text(F.col("num_words_wrapped"), F.col("num_wrapped_lines")).alias("text_density"),
        densities_link(F.col("num_anchor_words"), F.col("num_words")).alias("link_density"),
        F.col("block_idx").alias("offset_start"), F.col("block_idx").alias("offset_end"),
        F.when(F.col("block_idx") == 0, F.col("doc_level")).otherwise(F.col("level0")).cast("int").alias("tag_level"),
        "labels", F.lit(False).alias("is_content"), *extra)


def densities_text(words_wrapped: Column, lines: Column) -> Column:
    return (words_wrapped / lines).cast("double")


def densities_link(anchor_words: Column, words: Column) -> Column:
    return F.when(words == 0, F.lit(0.0)).otherwise(anchor_words / words).cast("double")


def html_docs(events: DataFrame) -> DataFrame:
    """H4: docs(doc_id, title): trimmed text of the TITLE element before BODY."""
    st = events.select(
        "doc_id", "pos", "kind", "text",
        F.coalesce(F.sum(F.when((F.col("tag") == "TITLE") & (F.col("kind") == "start"), 1)
                         .when((F.col("tag") == "TITLE") & (F.col("kind") == "end"), -1)).over(_w_before()),
                   F.lit(0)).alias("in_title"),
        F.coalesce(F.sum(F.when((F.col("tag") == "BODY") & (F.col("kind") == "start"), 1)
                         .when((F.col("tag") == "BODY") & (F.col("kind") == "end"), -1)).over(_w_before()),
                   F.lit(0)).alias("in_body"))
    t = st.where((F.col("kind") == "text") & (F.col("in_title") > 0) & (F.col("in_body") <= 0))
    title = java_trim(F.regexp_replace(F.min_by("text", "pos"), JAVA_WHITESPACE, " "))
    titled = t.groupBy("doc_id").agg(title.alias("title"))
    ids = events.select("doc_id").distinct()
    return ids.join(titled, "doc_id", "left").select(
        "doc_id", F.when(F.col("title") != "", F.col("title")).alias("title"))


def page_blocks(pages: DataFrame, actions: TagActions = DEFAULT_TAG_ACTIONS, **kw) -> DataFrame:
    return text_blocks(html_events(pages, **kw), actions)
