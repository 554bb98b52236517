"""DuckDB SQL oracles, one per registered query where SQL can express it.

Written independently of the Spark code path (RE2 regexes, DuckDB list
lambdas, window functions) over the same parquet tables.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- word counts

LINES = r"""
  SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id,
               CASE WHEN text = '' THEN []::VARCHAR[]
                    ELSE string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END AS arr
        FROM documents)
"""

WORDS = r"""
  SELECT doc_id, line_no, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS word_no, unnest(ws) AS word
  FROM (SELECT doc_id, line_no,
               CASE WHEN line = '' THEN ['']
                    WHEN regexp_replace(line, ' +$', '') = '' THEN []::VARCHAR[]
                    ELSE string_split(regexp_replace(line, ' +$', ''), ' ') END AS ws
        FROM (""" + LINES + """))
"""

ORACLES["read_text"] = LINES
ORACLES["tokenize_space"] = WORDS
ORACLES["filter_nonempty"] = f"SELECT * FROM ({WORDS}) WHERE word <> ''"
ORACLES["lowercase"] = f"SELECT doc_id, line_no, word_no, lower(word) AS word FROM ({WORDS})"
ORACLES["word_count"] = f"SELECT word, count(*) AS cnt FROM ({WORDS}) GROUP BY word"
ORACLES["top_k_words"] = f"SELECT word, count(*) AS cnt FROM ({WORDS}) GROUP BY word ORDER BY cnt DESC, word LIMIT 100"
ORACLES["top_k_threshold"] = f"""
  SELECT lower(word) AS word, count(*) AS cnt FROM ({WORDS})
  WHERE length(lower(word)) < 30 GROUP BY 1 HAVING count(*) > 5 ORDER BY cnt DESC, word LIMIT 100"""
ORACLES["having_count_and_len"] = f"""
  SELECT lower(word) AS word, count(*) AS cnt FROM ({WORDS})
  WHERE length(lower(word)) < 30 GROUP BY 1 HAVING count(*) > 5"""

# ---------------------------------------------------------------- HTML -> blocks
from webloom.plans.oracle_html import BLOCKS, DOCS, EVENTS  # noqa: E402

ORACLES["html_events"] = EVENTS
ORACLES["text_blocks"] = f"SELECT {', '.join(__import__('webloom.operators.classifiers', fromlist=['x']).BLOCK_COLUMNS)} FROM ({BLOCKS})"
ORACLES["title"] = DOCS

# ---------------------------------------------------------------- block rules, fusion, extractors
from webloom.plans import oracle_blocks as OB  # noqa: E402

_F5F1 = [OB.f5, OB.f1]
_RULE_STEPS = {
    "num_words_rules": [OB.f1],
    "density_rules": [OB.f2],
    "canola_rules": [OB.f3],
    "end_markers": [OB.f5],
    "ignore_after_end": _F5F1 + [OB.f6],
    "ignore_after_end_reverse": _F5F1 + [OB.f7],
    "keep_largest_fulltext": [OB.f1, OB.f8],
    "min_fulltext_words": [OB.f1, OB.f9],
    "min_words": [OB.f14, OB.f10],
    "min_clause_words": [OB.f14, OB.f11],
    "label_to_content": [lambda s: OB.f20(s, DOCS), OB.f12],
    "label_to_boilerplate": _F5F1 + [OB.f7, OB.f13],
    "mark_all_content": [OB.f14],
    "mark_all_boilerplate": [OB.f1, OB.f15],
    "invert": [OB.f1, OB.f16],
    "drop_boilerplate": [lambda s: OB.f20(s, DOCS), OB.f1, OB.f17],
    "surrounding_to_content": [OB.f1, OB.f18],
    "split_paragraphs": [OB.f1, OB.g1, OB.f19],
    "title_match": [lambda s: OB.f20(s, DOCS)],
    "keep_largest_block": [OB.f1, lambda s: OB.f21(s, True, 150)],
    "expand_title": [lambda s: OB.f20(s, DOCS), OB.f1, lambda s: OB.f21(s, True, 150), OB.f22],
    "large_same_level": [OB.f1, lambda s: OB.f21(s, False, 0), OB.f23],
    "list_at_end": [OB.f1, lambda s: OB.f21(s, True, 0), OB.f24],
    "trailing_headline": [OB.f1, OB.f25],
    "article_metadata": [OB.f26],
    "add_preceding_labels": [lambda s: OB.f27(s, "^")],
    "proximity_fusion": [OB.f1, OB.g1],
    "proximity_fusion_content_same_level": [OB.f1, lambda s: OB.g1(s, 1, True, True)],
    "density_fusion": [OB.g2],
    "label_fusion": [OB.g3],
    "content_fusion": _F5F1 + [OB.f7, OB.g4],
}
for _n, _steps in _RULE_STEPS.items():
    ORACLES[_n] = OB.chain(BLOCKS, *_steps)

ORACLES["fulltext_words"] = (f"SELECT doc_id, block_idx, CASE WHEN text_density >= 9 THEN num_words ELSE 0 END "
                             f"AS fulltext_words FROM ({BLOCKS})")

_EXTRACTOR_STEPS = {
    "article": OB.article_steps(DOCS),
    "article_sentences": OB.article_steps(DOCS) + [OB.f19, OB.f11],
    "default": [OB.g2, OB.g1, OB.f2],
    "largest_content": [OB.f1, OB.g1, lambda s: OB.f21(s, False, 0)],
    "canola": [OB.f3],
    "num_words": [OB.f1],
    "keep_everything": [OB.f14],
    "keep_everything_min_k": [OB.g2, OB.f14, OB.f10],
}
for _n, _steps in _EXTRACTOR_STEPS.items():
    ORACLES["extract_" + _n] = OB.content_text_sql(OB.chain(BLOCKS, *_steps), DOCS)

ORACLES["page_top_words"] = f"""
  SELECT word, count(*) AS cnt FROM (
    SELECT unnest(string_split(text, ' ')) AS word FROM ({ORACLES['extract_article']}))
  GROUP BY word ORDER BY cnt DESC, word LIMIT 100"""

# ---------------------------------------------------------------- text cleaning and vectors
from webloom.plans import oracle_text as OT  # noqa: E402
from webloom.plans import oracle_topics as TOPICS  # noqa: E402

_D = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents"
ORACLES["clean_text"] = OT.CLEAN_DOCS
ORACLES["remove_urls"] = f"SELECT doc_id, {OT.remove_urls_sql('text')} AS text FROM ({_D})"
ORACLES["remove_numbers"] = f"SELECT doc_id, {OT.remove_numbers_sql('text')} AS text FROM ({_D})"
ORACLES["ascii_fold"] = f"SELECT doc_id, {OT.fold_sql('text')} AS text FROM ({_D})"
ORACLES["strip_symbols"] = f"SELECT doc_id, {OT.strip_symbols_sql('text')} AS text FROM ({_D})"
ORACLES["append_newline"] = f"SELECT doc_id, {OT.clean_sql('text')} || chr(10) AS text FROM ({_D})"
ORACLES["analyze"] = f"SELECT doc_id, {OT.analyze_sql('text')} AS tokens FROM ({_D})"
ORACLES["stop_words"] = f"SELECT doc_id, {OT.analyze_sql('text', stem=False)} AS tokens FROM ({_D})"
ORACLES["stem"] = f"""SELECT term, {OT.porter_sql('[term]')}[1] AS stem FROM (
  SELECT DISTINCT unnest({OT.analyze_sql('text', stem=False)}) AS term FROM ({_D}))"""
ORACLES["extract_and_clean"] = (f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {OT.clean_sql('text')} AS text "
                                f"FROM ({ORACLES['extract_article']})")
ORACLES["distinct_terms"] = f"SELECT DISTINCT term FROM ({OT.TERM_COUNTS})"
ORACLES["assign_ids"] = OT.VOCAB
ORACLES["term_freq"] = OT.DOC_TERMS
ORACLES["doc_vectors"] = OT.DOC_VECTORS
ORACLES["doc_vectors_stemmed"] = OT.doc_vectors_sql(OT.term_counts_sql(stem=True))
ORACLES["join_vocab"] = f"""
  SELECT t.doc_id, t.term, v.term_id FROM (
    SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '\\n$', ''), ' '), lambda t: t <> '')) AS term
    FROM ({OT.CLEAN_DOCS})) t JOIN ({OT.VOCAB}) v USING (term)"""

ORACLES["topic_stats"] = TOPICS.TOPIC_STATS
ORACLES["normalize_topics"] = TOPICS.NORMALIZE_TOPICS
ORACLES["alpha_newton"] = TOPICS.ALPHA_NEWTON
ORACLES["lda_em_two_iterations"] = TOPICS.LDA_EM
_FAKE = "chr(13) || chr(10) || chr(13) || chr(10)"
_NESTED = f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN html || {_FAKE} || 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
  || 'Content-Length: 3' || {_FAKE} || 'abc' || {_FAKE} || html WHEN 1 THEN html || {_FAKE} || chr(13) || chr(10) ELSE html END AS html FROM pages"""
ORACLES["read_warc_payload_like_records"] = f"""
SELECT 'clueweb12-' || page_id AS trec_id, octet_length(encode(html))::BIGINT AS payload_bytes, html FROM ({_NESTED})"""
ORACLES["read_warc_charsets"] = rf"""
SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_full_match(html, '(?s)[\x00-\x7F\x{{A0}}-\x{{FF}}]*') THEN 'cp1252'
  WHEN page_id % 3 = 1 THEN 'utf-16-be' ELSE 'utf-8' END AS charset, md5(html) AS html_md5, coalesce(num_words, 0)::BIGINT AS num_words
FROM pages LEFT JOIN (SELECT doc_id, sum(num_words) AS num_words FROM ({BLOCKS}) GROUP BY doc_id) b ON page_id = b.doc_id"""
ORACLES["warc_rejects"] = """
SELECT CASE page_id % 7 WHEN 0 THEN 'no record header' WHEN 1 THEN 'no length' WHEN 2 THEN 'length is no number'
  WHEN 3 THEN 'length leads to no record end' WHEN 4 THEN 'no type' ELSE 'good' END AS reason, count(*) AS n FROM pages GROUP BY 1"""
ORACLES["corpus_size"] = f"SELECT count(DISTINCT doc_id) AS num_docs FROM ({OT.DOC_TERMS})"

# ---------------------------------------------------------------- crawl records, files
ORACLES["read_warc"] = ("SELECT 'clueweb12-' || CAST(page_id AS VARCHAR) AS trec_id, url, 'response' AS record_type, "
                        "regexp_replace(html, '(\\r\\n)+$', '') AS html FROM pages")
ORACLES["extract_header_lines"] = """
  SELECT CASE WHEN contains(line, 'WARC-TREC-ID') OR contains(line, 'WARC-Record-ID') THEN 'id' ELSE 'uri' END AS kind, line
  FROM (SELECT trim(l) AS line FROM (
    SELECT unnest(['WARC-TREC-ID: clueweb12-' || CAST(page_id AS VARCHAR), 'WARC-Target-URI: ' || url]) AS l FROM pages))"""
ORACLES["read_sparse_vectors"] = f"""
  SELECT doc_id AS label, CAST(split_part(p, ':', 1) AS INTEGER) AS term_id, CAST(split_part(p, ':', 2) AS DOUBLE) AS count
  FROM (SELECT doc_id, unnest(string_split(vector, ' ')) AS p FROM ({OT.DOC_VECTORS}))"""
ORACLES["distinct_topic_keys"] = f"""
  SELECT DISTINCT CAST(trim(split_part(e, ':', 1)) AS DOUBLE) AS key
  FROM (SELECT unnest(list_slice(string_split(vector, ' '), 1, 10)) AS e FROM ({OT.DOC_VECTORS}))"""
ORACLES["doc_index"] = f"""
  SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_index FROM ({OT.DOC_VECTORS})"""

# ---------------------------------------------------------------- anchors, stats
ORACLES["anchors"] = f"""
WITH st AS (
  SELECT *,
    sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_idx,
    sum(CASE WHEN tag = 'A' AND kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor_no,
    coalesce(last_value(CASE WHEN tag = 'A' AND kind = 'start' THEN true WHEN tag = 'A' AND kind = 'end' THEN false END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_a
  FROM ({EVENTS})
), s AS (
  SELECT doc_id, anchor_no,
    CASE WHEN regexp_matches(attrs, '(?i)(?:^|\\s)href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))')
         THEN regexp_extract(attrs, '(?i)(?:^|\\s)href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1)
           || regexp_extract(attrs, '(?i)(?:^|\\s)href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 2)
           || regexp_extract(attrs, '(?i)(?:^|\\s)href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 3) END AS href
  FROM st WHERE tag = 'A' AND kind = 'start'
), t AS (
  SELECT doc_id, anchor_no,
    string_agg(trim(regexp_replace(text, {OB.q(__import__('webloom.functions.tokens', fromlist=['x']).JAVA_WHITESPACE)}, ' ', 'g')), '' ORDER BY pos) AS anchor_text,
    max(run_idx) AS run_idx
  FROM st WHERE kind = 'text' AND in_a GROUP BY doc_id, anchor_no
)
SELECT s.doc_id, CAST(s.anchor_no AS BIGINT) AS anchor_no, CAST(t.run_idx AS BIGINT) AS run_idx,
       coalesce(t.anchor_text, '') AS anchor_text, s.href
FROM s LEFT JOIN t USING (doc_id, anchor_no)"""

ORACLES["doc_stats"] = f"""
  SELECT doc_id, CAST(sum(num_words) AS BIGINT) AS num_words, count(*) AS num_blocks,
         CAST(sum(num_words) AS DOUBLE) / count(*) AS avg_words
  FROM ({BLOCKS}) GROUP BY doc_id"""

ORACLES["low_quality"] = f"""
  WITH b AS (SELECT doc_id, sum(num_words) AS wb FROM ({BLOCKS}) GROUP BY doc_id),
       a AS (SELECT doc_id, sum(num_words) AS wa, CAST(sum(num_words) AS DOUBLE) / count(*) AS aa
             FROM ({OB.chain(BLOCKS, *OB.article_steps(DOCS))}) WHERE is_content GROUP BY doc_id)
  SELECT b.doc_id, (b.wb < 90 OR coalesce(a.wa, 0) < 70 OR coalesce(a.aa, 'NaN'::DOUBLE) < 25) AS low_quality
  FROM b LEFT JOIN a USING (doc_id)"""
ORACLES["conditional_label"] = f"""
  SELECT {OB.COLS} FROM (SELECT * REPLACE (CASE WHEN link_density = 0 AND num_words > 10
                         THEN list_sort(list_distinct(list_append(labels, 'LONG_TEXT'))) ELSE labels END AS labels)
  FROM ({BLOCKS}))"""

# ---------------------------------------------------------------- single-step helpers
from webloom.plans.oracle_html import tokens_sql  # noqa: E402

ORACLES["strip_tags"] = "SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages"
ORACLES["pair_with_one"] = f"SELECT word, 1 AS one FROM ({WORDS})"
ORACLES["join_content_text"] = f"""
  SELECT d.doc_id, d.title, coalesce(t.text, '') AS text FROM ({DOCS}) d LEFT JOIN (
    SELECT doc_id, string_agg(text || chr(10), '' ORDER BY block_idx) AS text FROM ({BLOCKS}) GROUP BY doc_id) t
  USING (doc_id)"""
ORACLES["count_words"] = f"""
  SELECT doc_id, block_idx, CAST(len(list_filter({tokens_sql('text')}, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS INTEGER) AS words
  FROM ({BLOCKS})"""
from webloom.plans.oracle_html import anchors_in_block_sql  # noqa: E402

ORACLES["anchors_in_block"] = anchors_in_block_sql(EVENTS, ORACLES["anchors"])


# ---------------------------------------------------------------- highlight
from webloom.plans.oracle_html import blocks_sql, inlist  # noqa: E402
from webloom.operators.html import DEFAULT_TAG_ACTIONS as _TA  # noqa: E402


def _highlight_sql(only_content: bool, pre: str = '<span class="x-content">', post: str = "</span>") -> str:
    owned = blocks_sql(EVENTS, with_owner=True)
    final = OB.chain(owned, *OB.article_steps(DOCS), extra=("members",))
    esc = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    marked = f"CASE WHEN content THEN {OB.q(pre)} || {esc} || {OB.q(post)} ELSE {esc} END"
    if only_content:
        piece = f"CASE WHEN kind = 'text' AND content THEN {marked} END"
    else:
        piece = (f"CASE WHEN kind = 'start' THEN '<' || lower(tag) || CASE WHEN attrs <> '' THEN ' ' || attrs ELSE '' END || '>' "
                 f"WHEN kind = 'end' THEN '</' || lower(tag) || '>' ELSE {marked} END")
    return f"""
WITH st AS (
  SELECT *, sum(CASE WHEN kind <> 'text' AND tag NOT IN {inlist(_TA.no_boundary())} THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
  FROM ({EVENTS})
), bo AS ({owned}),
cm AS (SELECT DISTINCT doc_id, unnest(members) AS block_idx FROM ({final}) WHERE is_content),
eb AS (
  SELECT st.doc_id, st.pos, cm.block_idx IS NOT NULL AS content
  FROM st JOIN bo ON st.doc_id = bo.doc_id AND st.owner = bo.owner
  LEFT JOIN cm ON bo.doc_id = cm.doc_id AND bo.block_idx = cm.block_idx
  WHERE st.kind = 'text'
), ev AS (SELECT st.*, eb.content FROM st LEFT JOIN eb USING (doc_id, pos))
SELECT doc_id, coalesce(string_agg({piece}, '' ORDER BY pos), '') AS html FROM ev GROUP BY doc_id"""


ORACLES["highlight"] = _highlight_sql(False)
ORACLES["highlight_content_only"] = _highlight_sql(True)


# ---------------------------------------------------------------- content images
from webloom.operators.html import IMPLIED_END as _IE  # noqa: E402
from webloom.operators.html_extras import IMAGE_IGNORED as _IMG_IGN  # noqa: E402


def _attr_sql(name: str) -> str:
    pat = OB.q(r"(?i)(?:^|\s)" + name + r"\s*=\s*(?:" + '"' + r"([^" + '"' + r"]*)" + '"' + r"|'([^']*)'|([^\s" + '"' + r"'>]+))")
    return (f"CASE WHEN regexp_matches(attrs, {pat}) THEN regexp_extract(attrs, {pat}, 1) || "
            f"regexp_extract(attrs, {pat}, 2) || regexp_extract(attrs, {pat}, 3) END")


def _images_sql() -> str:
    owned = blocks_sql(EVENTS, with_owner=True)
    final = OB.chain(owned, *OB.article_steps(DOCS), extra=("members",))
    from webloom.functions.tokens import JAVA_WHITESPACE
    ign_start = f"tag IN {inlist(_IMG_IGN)} AND kind = 'start' AND tag NOT IN {inlist(tuple(_IE))}"
    num = "'^\\s*[0-9]{1,9}\\s*$'"
    return f"""
WITH st AS (
  SELECT *, sum(CASE WHEN kind <> 'text' AND tag NOT IN {inlist(_TA.no_boundary())} THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner,
    coalesce(sum(CASE WHEN {ign_start} THEN 1 WHEN tag IN {inlist(_IMG_IGN)} AND kind = 'end' THEN -1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS ignored
  FROM ({EVENTS})
), bo AS ({owned}),
cm AS (SELECT DISTINCT doc_id, unnest(members) AS block_idx FROM ({final}) WHERE is_content),
core AS (
  SELECT st.doc_id, st.pos, cm.block_idx IS NOT NULL AS c, NULL::VARCHAR AS src, NULL::VARCHAR AS width,
         NULL::VARCHAR AS height, NULL::VARCHAR AS alt, false AS ignored
  FROM st JOIN bo ON st.doc_id = bo.doc_id AND st.owner = bo.owner
  LEFT JOIN cm ON bo.doc_id = cm.doc_id AND bo.block_idx = cm.block_idx
  WHERE st.kind = 'text' AND regexp_replace(st.text, {OB.q(JAVA_WHITESPACE)}, '', 'g') <> ''
), imgs AS (
  SELECT doc_id, pos, NULL::BOOLEAN AS c, {_attr_sql('src')} AS src, {_attr_sql('width')} AS width,
         {_attr_sql('height')} AS height, {_attr_sql('alt')} AS alt, ignored
  FROM st WHERE kind = 'start' AND tag = 'IMG'
), m AS (
  SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_c,
         max(CASE WHEN c THEN pos END) OVER (PARTITION BY doc_id) AS last_c
  FROM (SELECT * FROM core UNION ALL SELECT * FROM imgs)
), picked AS (
  SELECT doc_id, pos, src, width, height, alt,
    coalesce(CASE WHEN regexp_matches(width, {num}) THEN CAST(trim(width) AS BIGINT) END
             * CASE WHEN regexp_matches(height, {num}) THEN CAST(trim(height) AS BIGINT) END, -1) AS area
  FROM m WHERE c IS NULL AND coalesce(prev_c, false) AND last_c > pos AND src <> '' AND NOT ignored
)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, src, pos) - 1 AS INTEGER) AS rank FROM picked"""


ORACLES["content_images"] = _images_sql()


# ---------------------------------------------------------------- markup and font-size labels (DuckDB ASOF JOIN)
from webloom.operators.markup import DEFAULT_FONT_SIZE as _FS  # noqa: E402


def _markup_tags():
    skip = set(_TA.no_boundary()) | set(_TA.ignorable) | {"HTML", "BODY", "HEAD"}
    return [t for t in ("DIV", "P", "UL", "OL", "LI", "TABLE", "TR", "TD", "TH", "SECTION", "ARTICLE", "NAV",
                        "HEADER", "FOOTER", "ASIDE", "MAIN", "H1", "H2", "H3", "H4", "H5", "H6", "BLOCKQUOTE",
                        "PRE", "FORM", "DL", "DT", "DD", "FIGURE", "SPAN") if t not in skip]


def _depth_ctes(tags) -> str:
    """Tables sel, st and d: events with their depth, by a stack of open tags that a recursive query carries from tag to tag."""
    from webloom.operators import markup as M
    from webloom.operators.html import VOID_TAGS
    sel = f"(tag NOT IN {inlist(VOID_TAGS)})" if tags is None else f"(tag IN {inlist(tuple(tags))} AND tag NOT IN {inlist(VOID_TAGS)})"
    scope = "CASE tag WHEN 'TABLE' THEN [] " + " ".join(f"WHEN {OB.q(t)} THEN {_list(v)}" for t, v in M.SCOPES.items()) + f" ELSE {_list(M.SCOPE)} END"
    ended = "CASE x " + " ".join(f"WHEN {OB.q(t)} THEN {_list(v)}" for t, v in M.ENDED_BY.items()) + " ELSE [] END"
    return f"""
ev AS MATERIALIZED (SELECT * FROM ({EVENTS})),
sel AS MATERIALIZED (
  SELECT doc_id, pos, kind, tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, {scope} AS scope
  FROM ev WHERE {sel} AND kind IN ('start', 'end')),
st(doc_id, i, before, after) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM sel
  UNION ALL
  SELECT doc_id, i, len(cut)::BIGINT, CASE WHEN kind = 'start' THEN list_append(cut, tag) ELSE cut END FROM (
    SELECT doc_id, i, kind, tag, list_slice(after, 1, coalesce(CASE WHEN kind = 'start' THEN list_min(open) ELSE list_max(open) END - 1, len(after))) AS cut
    FROM (
      SELECT *, list_filter(range(floor_, len(after) + 1), lambda k: CASE WHEN kind = 'start' THEN list_contains(ended[k], tag) ELSE after[k] = tag END) AS open
      FROM (
        SELECT *, greatest(1, coalesce(list_max(list_filter(range(1, len(after) + 1), lambda k: list_contains(scope, after[k])
            AND NOT (CASE WHEN kind = 'start' THEN list_contains(ended[k], tag) ELSE after[k] = tag END))), 1)) AS floor_
        FROM (
          SELECT s.doc_id, s.i, s.kind, s.tag, s.scope, st.after, list_transform(st.after, lambda x: {ended}) AS ended
          FROM st JOIN sel s ON s.doc_id = st.doc_id AND s.i = st.i + 1))))),
dep AS MATERIALIZED (SELECT sel.doc_id, sel.pos, st.before, len(st.after)::BIGINT AS depth FROM st JOIN sel USING (doc_id, i)),
d AS (
  SELECT ev.*, coalesce({sel} AND ev.kind IN ('start', 'end'), false) AS sel,
    CASE WHEN dep.pos = ev.pos THEN dep.before ELSE coalesce(dep.depth, 0) END AS depth,
    sum(CASE WHEN ev.kind <> 'text' AND ev.tag NOT IN {inlist(_TA.no_boundary())} THEN 1 ELSE 0 END)
      OVER (PARTITION BY ev.doc_id ORDER BY ev.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
  FROM ev ASOF LEFT JOIN dep ON ev.doc_id = dep.doc_id AND ev.pos >= dep.pos)"""


def _list(values) -> str:
    return "[" + ", ".join(OB.q(v) for v in values) + "]"


def _block_probe_ctes(owned: str) -> str:
    from webloom.functions.tokens import JAVA_WHITESPACE
    return f"""
bo AS ({owned}),
bp AS (
  SELECT d.doc_id, bo.block_idx, min(d.pos) AS pos FROM d JOIN bo ON d.doc_id = bo.doc_id AND d.owner = bo.owner
  WHERE d.kind = 'text' AND regexp_replace(d.text, {OB.q(JAVA_WHITESPACE)}, '', 'g') <> ''
  GROUP BY d.doc_id, bo.block_idx
),
bpd AS (SELECT bp.doc_id, bp.block_idx, bp.pos, d.depth FROM bp JOIN d USING (doc_id, pos)),
bk AS (SELECT doc_id, block_idx, pos, unnest(range(depth)) AS k FROM bpd)"""


def _markup_sql() -> str:
    owned = blocks_sql(EVENTS, with_owner=True)
    cls = f"trim(regexp_replace(coalesce({_attr_sql('class')}, ''), '[0-9]+', '#', 'g'))"
    ident = f"regexp_replace(coalesce({_attr_sql('id')}, ''), '[0-9]+', '#', 'g')"
    return f"""
WITH RECURSIVE {_depth_ctes(_markup_tags())},
el0 AS (SELECT doc_id, pos, depth, tag, {cls} AS cls, {ident} AS ident FROM d WHERE sel AND kind = 'start'),
el AS (
  SELECT doc_id, pos, depth,
    list_concat(['<' || tag],
                CASE WHEN cls <> '' THEN ['<.' || replace(cls, ' ', '.')] ELSE []::VARCHAR[] END,
                CASE WHEN cls <> '' AND len(string_split_regex(cls, '[ ]+')) > 1
                     THEN list_transform(string_split_regex(cls, '[ ]+'), lambda s: '<.' || s) ELSE []::VARCHAR[] END,
                CASE WHEN ident <> '' THEN ['<#' || ident] ELSE []::VARCHAR[] END) AS own
  FROM el0
),
ek AS (SELECT doc_id, pos, unnest(range(depth)) AS k FROM el),
ea AS (
  SELECT ek.doc_id, ek.pos, list_distinct(flatten(list(a.own))) AS anc
  FROM ek ASOF JOIN el a ON ek.doc_id = a.doc_id AND ek.k = a.depth AND ek.pos > a.pos
  GROUP BY ek.doc_id, ek.pos
),
lwa AS (
  SELECT el.doc_id, el.pos, el.depth,
    list_distinct(list_concat(flatten(list_transform(coalesce(ea.anc, []::VARCHAR[]), lambda an:
        flatten(list_transform(el.own, lambda l: [an, an || ' ' || l])))), el.own)) AS lwa
  FROM el LEFT JOIN ea USING (doc_id, pos)
),
{_block_probe_ctes(owned)},
mk AS (
  SELECT bk.doc_id, bk.block_idx, list_distinct(flatten(list(l.lwa))) AS mk
  FROM bk ASOF JOIN lwa l ON bk.doc_id = l.doc_id AND bk.k = l.depth AND bk.pos > l.pos
  GROUP BY bk.doc_id, bk.block_idx
)
SELECT {OB.COLS} FROM (
  SELECT bo.* REPLACE (list_sort(list_distinct(list_concat(bo.labels, coalesce(mk.mk, []::VARCHAR[])))) AS labels)
  FROM bo LEFT JOIN mk USING (doc_id, block_idx))"""


def _font_sql() -> str:
    owned = blocks_sql(EVENTS, with_owner=True)
    sz = _attr_sql("size")
    return f"""
WITH RECURSIVE {_depth_ctes(("FONT",))},
f0 AS (
  SELECT doc_id, pos, depth,
    CASE WHEN regexp_matches({sz}, '^([+-]?)([0-9])$') THEN regexp_extract({sz}, '^([+-]?)([0-9])$', 1) END AS rel,
    CASE WHEN regexp_matches({sz}, '^([+-]?)([0-9])$') THEN CAST(regexp_extract({sz}, '^([+-]?)([0-9])$', 2) AS INTEGER) END AS val
  FROM d WHERE sel AND kind = 'start'
),
fk AS (SELECT doc_id, pos, unnest(range(depth)) AS k FROM f0 WHERE val IS NOT NULL),
fp AS (
  SELECT fk.doc_id, fk.pos, fk.k, a.rel, a.val FROM fk ASOF JOIN f0 a ON fk.doc_id = a.doc_id AND fk.k = a.depth AND fk.pos > a.pos
  UNION ALL SELECT doc_id, pos, depth, rel, val FROM f0 WHERE val IS NOT NULL
),
fs AS (
  SELECT doc_id, pos, sum(CASE rel WHEN '+' THEN val WHEN '-' THEN -val ELSE 0 END) + coalesce(max(val) FILTER (rel = ''), {_FS}) AS size
  FROM (SELECT *, max(CASE WHEN rel = '' THEN k END) OVER (PARTITION BY doc_id, pos) AS anew FROM fp WHERE val IS NOT NULL)
  WHERE anew IS NULL OR k >= anew GROUP BY doc_id, pos
),
fe AS (SELECT f0.doc_id, f0.pos, f0.depth, fs.size FROM f0 LEFT JOIN fs USING (doc_id, pos)),
{_block_probe_ctes(owned)},
fl AS (
  SELECT doc_id, block_idx, 'font-' || CAST(arg_max(size, k) FILTER (WHERE size IS NOT NULL) AS VARCHAR) AS fl FROM (
    SELECT bk.doc_id, bk.block_idx, bk.k, e.size FROM bk ASOF JOIN fe e
      ON bk.doc_id = e.doc_id AND bk.k = e.depth AND bk.pos > e.pos)
  GROUP BY doc_id, block_idx
)
SELECT {OB.COLS} FROM (
  SELECT bo.* REPLACE (CASE WHEN fl.fl IS NOT NULL THEN list_sort(list_distinct(list_append(bo.labels, fl.fl)))
                            ELSE bo.labels END AS labels)
  FROM bo LEFT JOIN fl USING (doc_id, block_idx))"""


ORACLES["markup_labels"] = _markup_sql()
ORACLES["font_size_labels"] = _font_sql()
_CHANGED = "FROM (SELECT page_id, url, {} AS html FROM pages)"
ORACLES["font_size_labels_nested"] = ORACLES["font_size_labels"].replace("FROM pages", _CHANGED.format(
    """replace(replace(replace(replace(replace(replace(html, '<article', '<font size="5"><article'), '</article>', '</article></font>'),
    '<p>', '<font size="+1"><p>'), '</p>', '</p></font>'), '<b>', '<font size="-2"><font><b>'), '</b>', '</b></font></font>')"""))
ORACLES["markup_labels_unclosed"] = ORACLES["markup_labels"].replace("FROM pages", _CHANGED.format(
    "replace(replace(replace(html, '</p>', ''), '</li>', ''), '<p>', '<p class=\"x y7\">')"))


# ---------------------------------------------------------------- highlight, extracting mode: elements by a stack, what they hold by range joins
from webloom.operators.content_html import ARTICLE_TAGS, ATTRIBUTE as _ATTRIBUTE  # noqa: E402
from webloom.plans.oracle_html import decode_sql  # noqa: E402


def _extract_html_sql(whitelist: dict[str, tuple[str, ...]] | None) -> str:
    from webloom.functions.tokens import JAVA_WHITESPACE
    owned = blocks_sql(EVENTS, with_owner=True)
    final = OB.chain(owned, *OB.article_steps(DOCS), extra=("members",))
    pat = OB.q(_ATTRIBUTE.replace('\\"', '"'))
    allowed, listed = "true", "true"
    if whitelist is not None:
        names = " ".join(f"WHEN {OB.q(t)} THEN {_list(a)}::VARCHAR[]" for t, a in whitelist.items())
        allowed = f"list_contains(CASE lower(tag) {names} END, n)"
        listed = f"lower(tag) IN {inlist(tuple(whitelist))}"

    def esc(x: str) -> str:
        return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"

    return f"""
WITH RECURSIVE {_depth_ctes(None)},
bo AS ({owned}),
cm AS (SELECT DISTINCT doc_id, unnest(members) AS block_idx FROM ({final}) WHERE is_content),
ct AS MATERIALIZED (
  SELECT d.doc_id, d.pos, {esc('d.text')} AS piece FROM d JOIN bo ON d.doc_id = bo.doc_id AND d.owner = bo.owner
  JOIN cm ON cm.doc_id = bo.doc_id AND cm.block_idx = bo.block_idx
  WHERE d.kind = 'text' AND regexp_replace(d.text, {OB.q(JAVA_WHITESPACE)}, '', 'g') <> ''),
el AS MATERIALIZED (
  SELECT s.doc_id, s.pos, s.before AS depth, coalesce(min(e.pos), 1::BIGINT << 62) AS end_pos
  FROM dep s JOIN d ON d.doc_id = s.doc_id AND d.pos = s.pos AND d.kind = 'start'
  LEFT JOIN dep e ON e.doc_id = s.doc_id AND e.pos > s.pos AND e.before <= s.before GROUP BY ALL),
kept AS MATERIALIZED (
  SELECT el.*, d.tag, d.attrs FROM el JOIN d USING (doc_id, pos) WHERE {listed}
  AND EXISTS (SELECT 1 FROM ct WHERE ct.doc_id = el.doc_id AND ct.pos > el.pos AND ct.pos < el.end_pos)),
att AS (
  SELECT doc_id, pos, string_agg(' ' || n || '="' || {esc('v')} || '"', '' ORDER BY i) AS attrs FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, pos, n ORDER BY i) AS again FROM (
      SELECT doc_id, pos, tag, i, lower(regexp_extract(m, {pat}, 1)) AS n, {decode_sql('val')} AS v FROM (
        SELECT *, regexp_extract(m, {pat}, 2) || regexp_extract(m, {pat}, 3) || regexp_extract(m, {pat}, 4) AS val FROM (
          SELECT doc_id, pos, tag, unnest(ms) AS m, unnest(range(len(ms))) AS i
          FROM (SELECT *, regexp_extract_all(coalesce(attrs, ''), {pat}) AS ms FROM kept)))))
  WHERE again = 1 AND {allowed} GROUP BY doc_id, pos),
pieces AS (
  SELECT doc_id, pos AS place, 1 AS turn, 0 AS sub, pos AS elem, 's' AS what, '<' || lower(tag) || coalesce(att.attrs, '') || '>' AS piece
  FROM kept LEFT JOIN att USING (doc_id, pos)
  UNION ALL SELECT doc_id, end_pos, 0, -depth, pos, 'e', '</' || lower(tag) || '>' FROM kept
  UNION ALL SELECT doc_id, pos, 1, 0, pos, 't', piece FROM ct),
num AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, turn, sub) AS i,
    row_number() OVER (PARTITION BY doc_id ORDER BY place DESC, turn DESC, sub DESC) AS r FROM pieces),
gone AS (
  SELECT s.doc_id, s.elem FROM num s JOIN num e ON s.doc_id = e.doc_id AND s.elem = e.elem AND s.what = 's' AND e.what = 'e' AND s.i = e.r
  JOIN num s2 ON s2.doc_id = s.doc_id AND s2.i = s.i + 1 AND s2.what = 's' JOIN num e2 ON e2.doc_id = s.doc_id AND e2.r = e.r + 1 AND e2.what = 'e'
  WHERE NOT EXISTS (SELECT 1 FROM num t WHERE t.doc_id = s.doc_id AND t.what = 't' AND (t.i < s.i OR t.r < e.r)))
SELECT p.doc_id, coalesce(h.html, '') AS html FROM (SELECT DISTINCT doc_id FROM ev) p LEFT JOIN (
  SELECT doc_id, string_agg(piece, '' ORDER BY i) AS html FROM num ANTI JOIN gone USING (doc_id, elem) GROUP BY doc_id) h USING (doc_id)"""


ORACLES["extract_html"] = _extract_html_sql(None)
ORACLES["extract_html_whitelist"] = _extract_html_sql(ARTICLE_TAGS).replace("FROM pages", _CHANGED.format(
    """replace(replace(replace(html, '</p>', ' see <a title="x > y" HREF="/q?a=1&amp;b=&quot;2" href="/r">this</a> <i></i><br>'),
    '</li>', ''), '<article', '<article class=main id=m')"""))
