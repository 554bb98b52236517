"""HTML -> events -> blocks on hand-made pages; block rules and fusion."""

from pyspark.sql import functions as F

PAGE = ("<html><head><title>My Title - Site</title><style>p{}</style>"
        "<script>var s=\"</p><div>\";</script></head><body>"
        "<nav><ul><li><a href='/x'>Home</a></li><li><a href=\"/y\">News</a></li></ul></nav>"
        "<!-- comment <p>hidden</p> -->"
        "<div><h1>My Title</h1><p>First paragraph has <b>bold</b> text &amp; an entity.<p>Second "
        "paragraph, with a <a href=/z>link here</a> and more words.</p></div>"
        "<footer>&copy; 2024 Foo</footer>")


def _blocks(spark, html):
    from webloom.operators.html import html_docs, html_events, text_blocks
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    ev = html_events(pages)
    return ev, text_blocks(ev), html_docs(ev)


def test_blocks_of_handmade_page(spark):
    ev, b, d = _blocks(spark, PAGE)
    rows = b.orderBy("block_idx").collect()
    texts = [r.text for r in rows]
    assert texts == ["Home", "News", "My Title", "First paragraph has bold text & an entity.",
                     "Second paragraph, with a link here and more words.", "© 2024 Foo"]
    assert "hidden" not in " ".join(texts) and "var s" not in " ".join(texts)
    second = rows[4]
    assert second.num_words == 9 and second.num_anchor_words == 2
    assert abs(second.link_density - 2 / 9) < 1e-12
    assert rows[0].labels == ["LI"] and rows[2].labels == ["H1", "HEADING"]
    assert [r.block_idx for r in rows] == list(range(6))
    assert d.first().title == "My Title - Site"


def test_wrapped_lines_counts(spark):
    words = " ".join(["word"] * 40)  # 40 words of 4 letters: 16 per 80-char line
    _, b, _ = _blocks(spark, f"<html><body><p>{words}</p></body></html>")
    r = b.first()
    assert r.num_words == 40 and r.num_wrapped_lines == 2 and r.num_words_wrapped == 32
    assert r.text_density == 16.0


def test_empty_page_has_no_blocks(spark):
    _, b, d = _blocks(spark, "<html><head><title>T</title></head><body>  </body></html>")
    assert b.count() == 0 and d.first().title == "T"


def _mk(spark, rows):
    """rows: (num_words, link_density[, tag_level[, content]])"""
    data = []
    for i, r in enumerate(rows):
        w, ld = r[0], r[1]
        lvl = r[2] if len(r) > 2 else 3
        c = r[3] if len(r) > 3 else False
        data.append((1, i, f"b{i}", w, int(round(ld * w)), w, 1, float(w), float(ld), i, i, lvl, [], c))
    schema = ("doc_id long, block_idx int, text string, num_words int, num_anchor_words int, num_words_wrapped int, "
              "num_wrapped_lines int, text_density double, link_density double, offset_start int, offset_end int, "
              "tag_level int, labels array<string>, is_content boolean")
    return spark.createDataFrame(data, schema)


def _content(df):
    return [r.is_content for r in df.orderBy("block_idx").collect()]


def test_num_words_rules_boundaries(spark):
    from webloom.operators.classifiers import num_words_rules
    assert _content(num_words_rules(_mk(spark, []))) == []
    assert _content(num_words_rules(_mk(spark, [(16, 0.0)]))) == [False]       # prev 0 words, next 0
    assert _content(num_words_rules(_mk(spark, [(17, 0.0)]))) == [True]
    assert _content(num_words_rules(_mk(spark, [(5, 0.0), (10, 0.0)]))) == [False, True]   # prev 5 > 4
    assert _content(num_words_rules(_mk(spark, [(4, 0.0), (10, 0.0), (16, 0.0)]))) == [False, True, True]
    assert _content(num_words_rules(_mk(spark, [(10, 0.0), (4, 0.0), (16, 0.0)]))) == [False, True, False]
    # 1/3 lies above the 0.333333 threshold (boilerplate); 5/9 lies below 0.555556
    assert _content(num_words_rules(_mk(spark, [(9, 1 / 3), (40, 0.0)]))) == [False, True]
    assert _content(num_words_rules(_mk(spark, [(9, 5 / 9), (16, 0.0), (3, 0.0)]))) == [False, True, True]
    # previous link density above 0.555556: needs > 40 words or a next block > 17 words
    assert _content(num_words_rules(_mk(spark, [(10, 0.6), (40, 0.0), (17, 0.0)]))) == [False, False, True]
    assert _content(num_words_rules(_mk(spark, [(10, 0.6), (40, 0.0), (18, 0.0)]))) == [False, True, True]


def test_fusion_keeps_words_and_invert_twice(spark):
    from webloom.operators.classifiers import invert, num_words_rules
    from webloom.operators.fusion import content_fusion, density_fusion, proximity_fusion
    b = num_words_rules(_mk(spark, [(20, 0.0), (3, 0.6), (30, 0.0), (2, 0.0), (50, 0.1), (7, 0.0)]))
    total = b.agg(F.sum("num_words")).first()[0]
    for f in (proximity_fusion, density_fusion, content_fusion):
        assert f(b).agg(F.sum("num_words")).first()[0] == total
    assert _content(invert(invert(b))) == _content(b)
    merged = proximity_fusion(b)
    assert merged.count() < b.count()


def test_keep_largest_block_expands_same_level(spark):
    from webloom.operators.classifiers import keep_largest_block
    b = _mk(spark, [(200, 0.0, 3, True), (10, 0.0, 2, True), (160, 0.0, 3, False), (300, 0.0, 3, True),
                    (151, 0.0, 4, False), (170, 0.0, 3, False)])
    out = keep_largest_block(b, True, 150).orderBy("block_idx").collect()
    assert [r.is_content for r in out] == [False, False, True, True, False, True]
    assert "VERY_LIKELY_CONTENT" in out[3].labels and "MIGHT_BE_CONTENT" in out[0].labels


def test_article_extraction_on_driver_pages(spark):
    from webloom.plans.extractors import extract
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extract(pages, "article").collect()
    assert len(rows) == 50
    assert sum(1 for r in rows if r.text) >= 40
    assert all("track(" not in r.text for r in rows)


def test_anchors_images_highlight(spark):
    from webloom.operators.html import html_docs, html_events, text_blocks
    from webloom.operators.html_extras import anchors, content_images, highlight, rank_images
    from webloom.operators.classifiers import mark_all_content
    html = ("<html><body><p>" + " ".join(["alpha"] * 30) + "</p><img src='big.png' width='20' height='10'>"
            "<img src='small.png' width='x'><p>" + " ".join(["beta"] * 30) + " <a href='/q'>the link</a></p>"
            "</body></html>")
    pages = spark.createDataFrame([(7, "u", html)], "page_id long, url string, html string")
    ev = html_events(pages)
    bo = text_blocks(ev, keep_owner=True)
    a = anchors(ev).collect()
    assert [(r.anchor_text, r.href) for r in a] == [("the link", "/q")]
    final = mark_all_content(bo.drop("owner"))
    imgs = rank_images(content_images(ev, final, bo)).orderBy("rank").collect()
    assert [(r.src, r.area) for r in imgs] == [("big.png", 200), ("small.png", -1)]
    h = highlight(ev, final, bo, pre="[", post="]").first().html
    assert "[alpha" in h and "<img src='big.png'" in h
    assert html_docs(ev).first().title is None


def test_markup_and_font_labels(spark):
    from webloom.operators.html import html_events, text_blocks
    from webloom.operators.markup import font_size_labels, markup_labels
    html = ("<html><body><div id='main12' class='content x3'><p>First para text here.</p>"
            "<div class='inner'><font size='5'>Big</font> and <font size='+1'>more</font></div></div>"
            "<p><font size='-1'>outside</font></p></body></html>")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    ev = html_events(pages)
    bo = text_blocks(ev, keep_owner=True)
    mk = {r.text: r.labels for r in markup_labels(ev, bo).collect()}
    first = mk["First para text here."]
    assert {"<DIV", "<#main#", "<.content.x#", "<.content", "<.x#", "<P", "<DIV <P", "<#main# <P"} <= set(first)
    assert "<.inner" in mk["Big and more"] and "<DIV <.inner" in mk["Big and more"]
    assert mk["outside"] == ["<P"]
    fl = {r.text: r.labels for r in font_size_labels(ev, bo).collect()}
    assert fl["Big and more"] == ["font-5"] and fl["outside"] == ["font-2"] and fl["First para text here."] == []


def _labels(spark, html, fn):
    from webloom.operators.html import html_events, text_blocks
    ev = html_events(spark.createDataFrame([(1, "u", f"<html><body>{html}</body></html>")], "page_id long, url string, html string"))
    return {r.text: r.labels for r in fn(ev, text_blocks(ev, keep_owner=True)).collect()}


def test_markup_labels_end_what_the_next_start_implies(spark):
    """Worked by hand: unclosed paragraphs, items, definitions and cells, stray ends, a list in an item, a table in a paragraph's item."""
    from webloom.operators.markup import markup_labels
    got = _labels(spark, "<p id='a'>one<p id='b'>two<div class='d'>three</div>"
                  "<ul><li id='i'>four<p id='c'>five<li id='j'>six<ul><li id='k'>seven</ul>eight</ul>nine</p></em>"
                  "<dl><dt id='t'>ten<dd id='u'>eleven<dt id='v'>twelve</dl>"
                  "<table><tr id='r'><td id='x'>thirteen<td id='y'>fourteen<p id='e'>fifteen<tr id='s'><td>sixteen</table>"
                  "<section id='w'><p id='f'>seventeen</section>eighteen", markup_labels)
    own = {t: sorted(x[2:] for x in labels if x.startswith("<#") and " " not in x) for t, labels in got.items()}
    assert own == {"one": ["a"], "two": ["b"], "three": [], "four": ["i"], "five": ["c", "i"], "six": ["j"], "seven": ["j", "k"],
                   "eight": ["j"], "nine": [], "ten": ["t"], "eleven": ["u"], "twelve": ["v"], "thirteen": ["r", "x"],
                   "fourteen": ["r", "y"], "fifteen": ["e", "r", "y"], "sixteen": ["s"], "seventeen": ["f", "w"], "eighteen": []}
    assert "<UL <LI" in got["seven"] and "<LI <UL" in got["seven"] and "<#i <#c" in got["five"] and "<P" not in got["three"]


def test_relative_font_sizes_add_up(spark):
    """Worked by hand: relative in relative, an absolute size starts anew, unsized fonts and stray ends count for nothing."""
    from webloom.operators.markup import font_size_labels
    got = _labels(spark, "<div><font size='+1'><p>four</p><font size='+1'><p>five</p><font><p>unsized in five</p><font size='-2'>"
                  "<p>three</p></font></font><font size='6'><p>six</p><font size='-1'><p>again five</p></font></font></font>"
                  "<p>back to four</p></font></font><p>none</p><font size='big'><p>no size</p></font>"
                  "<font size='-1'><p>two</p></font></div>", font_size_labels)
    assert got == {"four": ["font-4"], "five": ["font-5"], "unsized in five": ["font-5"], "three": ["font-3"], "six": ["font-6"],
                   "again five": ["font-5"], "back to four": ["font-4"], "none": [], "no size": [], "two": ["font-2"]}


def test_font_label_ignores_closed_sibling(spark):
    from webloom.operators.html import html_events, text_blocks
    from webloom.operators.markup import font_size_labels
    html = ("<html><body><p><font size='5'>sized</font></p><p><font>unsized sibling</font></p>"
            "<p><font size='-2'>relative</font></p></body></html>")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    ev = html_events(pages)
    fl = {r.text: r.labels for r in font_size_labels(ev, text_blocks(ev, keep_owner=True)).collect()}
    assert fl == {"sized": ["font-5"], "unsized sibling": [], "relative": ["font-1"]}


def test_nested_list_levels_and_labels(spark):
    html = ("<html><body><nav><ul><li><a href='/a'>A</a><ul><li>B</li><li>B2<ol><li>deep</li></ol></li></ul>C</li>"
            "<li>D<li>E</ul></nav><p>F <b>bold</b></p><ul><li>x<li>y</ul><div>G</div></body></html>")
    _, b, _ = _blocks(spark, html)
    got = [(r.text, r.tag_level, r.labels) for r in b.orderBy("block_idx").collect()]
    assert got == [("A", 6, ["LI"]), ("B", 7, ["LI"]), ("B2", 7, ["LI"]), ("deep", 9, ["LI"]), ("C", 5, ["LI"]),
                   ("D", 5, ["LI"]), ("E", 5, ["LI"]), ("F bold", 3, []), ("x", 4, ["LI"]), ("y", 4, ["LI"]),
                   ("G", 3, [])]


def _texts(spark, html):
    return [(r.text, r.tag_level, r.labels) for r in _blocks(spark, html)[1].orderBy("block_idx").collect()]


def test_page_without_body_tag_gets_one(spark):
    with_body = _texts(spark, "<html><head><title>T</title></head><body><p>one two</p></body></html>")
    assert with_body == [("one two", 3, [])]  # HTML, BODY, P
    assert _texts(spark, "<html><head><title>T</title></head><p>one two</p></html>") == with_body
    assert [t for t, _, _ in _texts(spark, "plain <b>text</b>")] == ["plain text"]


def test_stray_end_tags_change_nothing(spark):
    want = _texts(spark, "<html><body><div><h2>head</h2><p>one two</p></div></body></html>")
    assert want == [("head", 4, ["H2", "HEADING"]), ("one two", 4, [])]
    assert _texts(spark, "<html><body></h2><div><h2>head</h2></noscript></section><p>one two</p></div></body></html>") == want
    hidden = _texts(spark, "<html><body></noscript><noscript>hidden</noscript><p>one two</p></body></html>")
    assert [t for t, _, _ in hidden] == ["one two"]


def test_quoted_angle_bracket_does_not_end_a_tag(spark):
    from webloom.operators.html import html_events
    html = "<body><a title=\"a > b\" rel='x > y' href=\"x\">link text</a> <p class=\"open>rest" + "<i " + "k=\"v\" " * 20000 + ">t</i>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    first = html_events(pages).filter("tag = 'A' and kind = 'start'").first()
    assert first.attrs == "title=\"a > b\" rel='x > y' href=\"x\""
    assert "link text" in _texts(spark, html)[0][0]


def test_records_of_one_page_id_are_not_spliced(spark):
    from webloom.operators.html import html_events, text_blocks
    pages = spark.createDataFrame([(1, "u", "<body><p>alpha</p></body>"), (1, "u", "<body><p>one two</p></body>"),
                                   (1, "u", None), (2, "u", "<body>x</body>")], "page_id long, url string, html string")
    assert [(r.doc_id, r.text) for r in text_blocks(html_events(pages)).orderBy("doc_id").collect()] == [
        (1, "one two"), (2, "x")]


def test_reverse_end_scan_and_paragraph_split_keep_members(spark):
    from webloom.operators.classifiers import ignore_after_end_reverse, split_paragraphs
    b = _mk(spark, [(20, 0.0, 3, True), (5, 0.0, 3, True)]).withColumn("members", F.array("block_idx"))
    for rule in (ignore_after_end_reverse, split_paragraphs):
        assert [r.members for r in rule(b).orderBy("block_idx").collect()] == [[0], [1]]


def test_extracted_html_is_balanced_and_holds_content_only(spark):
    from webloom.operators.classifiers import mark_all_content
    from webloom.operators.content_html import extract_html
    from webloom.operators.html import html_events, text_blocks

    def extracted(html, **options):
        ev = html_events(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
        bo = text_blocks(ev, keep_owner=True)
        return extract_html(ev, mark_all_content(bo.drop("owner")), bo, **options).first().html

    page = ("<html><head><title>t</title><style>p{}</style></head><body><div id=a ID='b' title='x &lt; \"y\"' hidden><div><i></i><br></div>"
            "<p>one &amp; <b>two</b><p>three</em> four<ul><li>five<li>six</ul><script>no()</script></div><div><i> </i></div></body></html>")
    inner = "<p>one &amp; <b>two</b></p><p>three four</p><ul><li>five</li><li>six</li></ul>"
    assert extracted(page).replace("</b>\n", "</b>") == inner
    both = page.replace("<div id=a", "<p>first</p><div id=a")
    assert extracted(both) == '<p>first</p><div id="a" title="x &lt; &quot;y&quot;" hidden="">' + inner + "</div>"
    assert extracted(both, whitelist={"div": ("Title",), "LI": ()}, pre="[", post="]") == (
        '[first]<div title="x &lt; &quot;y&quot;">[one &amp; ][two][three][ four]<li>[five]</li><li>[six]</li></div>')
    assert extracted("<html><body><p>alone</p></body></html>") == "<p>alone</p>"
    assert extracted("<html><body><p> </p><i></i></body></html>") == ""


def test_partitions_of_pages_follow_their_bytes(spark, monkeypatch):
    """A task's share of a page job stays the same whatever the table's size."""
    from webloom.operators import html as H
    monkeypatch.setattr(H, "PARTITION_BYTES", 1000)
    pages = spark.createDataFrame([(i, "<p>" + "word " * 20) for i in range(500)], "page_id long, html string")
    assert H.partition_pages(pages).rdd.getNumPartitions() == 52  # 500 pages of 103 bytes
    monkeypatch.setattr(H, "PARTITION_BYTES", 1 << 20)
    assert H.partition_pages(pages).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_spaces_and_trims_are_those_of_the_patterns(spark):
    from webloom.functions.tokens import JAVA_WHITESPACE, spaces_only, trim_spaces
    texts = ["", " ", " a b ", "a\tb\n", " a \u0085", "\u3000a\u2003 ", "a\u00a0 ", "\x1ca\x1f", "  plain  text  ", "a \u0085\u0085 ", "\u0085 a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    spaced = F.regexp_replace("t", JAVA_WHITESPACE, " ")
    for r in rows.select("t", spaces_only(F.col("t")).alias("a"), spaced.alias("b"), trim_spaces(F.col("t")).alias("c"),
                         F.regexp_replace("t", "^ +| +$", "").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), repr(r.t)


def test_blocks_are_counted_once(spark):
    """The filter on the counts reads the aggregate's result; the fold over the tokens stands in the plan once."""
    from webloom.operators.html import html_events, text_blocks
    pages = spark.createDataFrame([(1, "<p>one two</p>")], "page_id long, html string")
    plan = text_blocks(html_events(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("aggregate(transform(filter(" in line for line in plan.split("\n")) == 1
