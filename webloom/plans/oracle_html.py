"""DuckDB oracle SQL for the HTML event table and the text blocks.

The tag lists are shared facts (``webloom.operators.html``); the evaluation is
DuckDB's own: RE2 regexes with capture groups instead of look-arounds,
``list_reduce`` for the per-block fold, DuckDB window frames.
"""

from __future__ import annotations

from html.entities import name2codepoint

from webloom.functions.tokens import JAVA_WHITESPACE, JOINING_PUNCT, MAX_LINE_LENGTH
from webloom.operators.html import (ATTRS_RE, DEFAULT_TAG_ACTIONS, HEAD_TAGS, IMPLIED_END, LIST_TAGS, TAG_NAME_RE, VOID_TAGS)

TOKEN_RE = (r"</?[A-Za-z](?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*>|</?[A-Za-z][^>]*>"
            r"|<![^>]*>|<\?[^>]*>|[^<]+|<")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(tags) -> str:
    return "(" + ", ".join(q(t) for t in tags) + ")"


ENTITY_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(chr(v))}" for k, v in sorted(name2codepoint.items())) + "}"
ENTITY_PIECES = r"&[A-Za-z][A-Za-z0-9]*;|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|[^&]+|&"


def _cp(n: str) -> str:
    return f"CASE WHEN {n} > 0 AND {n} <= 1114111 AND NOT ({n} BETWEEN 55296 AND 57343) THEN chr(CAST({n} AS INTEGER)) ELSE '\ufffd' END"


def decode_sql(x: str) -> str:
    piece = (f"CASE WHEN regexp_matches(p, '^&#[xX][0-9A-Fa-f]+;$') THEN "
             f"{_cp(chr(40) + 'CAST(' + chr(39) + '0x' + chr(39) + ' || substr(p, 4, length(p) - 4) AS BIGINT)' + chr(41))} "
             f"WHEN regexp_matches(p, '^&#[0-9]+;$') THEN {_cp('(CAST(substr(p, 3, length(p) - 3) AS BIGINT))')} "
             f"WHEN regexp_matches(p, '^&[A-Za-z][A-Za-z0-9]*;$') THEN coalesce({ENTITY_MAP}[substr(p, 2, length(p) - 2)], p) "
             f"ELSE p END")
    return (f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(regexp_extract_all({x}, {q(ENTITY_PIECES)}), "
            f"lambda p: {piece}), '') ELSE {x} END")


def events_sql(pages: str = "pages") -> str:
    return f"""
SELECT doc_id, pos, kind,
       CASE WHEN kind <> 'text' THEN upper(regexp_extract(tok, {q(TAG_NAME_RE)}, 1)) END AS tag,
       CASE WHEN kind = 'start' THEN regexp_extract(tok, {q(ATTRS_RE)}, 1) END AS attrs,
       CASE WHEN kind = 'text' THEN {decode_sql('tok')} END AS text
FROM (
  SELECT doc_id, pos, tok,
         CASE WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'end'
              WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'start'
              WHEN regexp_matches(tok, '^<[!?]') THEN NULL ELSE 'text' END AS kind
  FROM (
    SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS tok
    FROM (
      SELECT CAST(page_id AS BIGINT) AS doc_id,
             regexp_extract_all(max(
               regexp_replace(regexp_replace(regexp_replace(html,
                 '(?s)<!--.*?(-->|\\z)', '', 'g'),
                 '(?is)(<script\\b[^>]*>).*?(</script\\s*>|\\z)', '\\1</script>', 'g'),
                 '(?is)(<style\\b[^>]*>).*?(</style\\s*>|\\z)', '\\1</style>', 'g')),
               {q(TOKEN_RE)}) AS toks
      FROM {pages} WHERE page_id IS NOT NULL GROUP BY page_id)))
WHERE kind IS NOT NULL"""


_W = r"\p{L}\p{Nd}_"
_OTHER = "[^" + _W + " " + JOINING_PUNCT + "]"


def tokens_sql(x: str) -> str:
    """Block tokens: split at word/other borders (two capture passes), then at spaces."""
    p1 = f"regexp_replace({x}, {q('([' + _W + '])(' + _OTHER + ')')}, '\\1 \\2', 'g')"
    p2 = f"regexp_replace({p1}, {q('(' + _OTHER + ')([' + _W + '])')}, '\\1 \\2', 'g')"
    return f"list_filter(string_split(regexp_replace({p2}, ' +', ' ', 'g'), ' '), lambda t: t <> '')"


def counts_sql(tokens: str, a0: str) -> str:
    step = (
        "lambda acc, t: {"
        "'a': CASE WHEN t = '\ue00a' THEN true WHEN t = '\ue00b' THEN false ELSE acc.a END, "
        "'n': acc.n + CASE WHEN t IN ('\ue00a', '\ue00b') THEN 0 ELSE 1 END, "
        "'w': acc.w + CASE WHEN regexp_matches(t, '[\\p{L}\\p{N}]') THEN 1 ELSE 0 END, "
        "'l': acc.l + CASE WHEN regexp_matches(t, '[\\p{L}\\p{N}]') AND acc.a THEN 1 ELSE 0 END, "
        f"'len': CASE WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN acc.len "
        f"WHEN acc.len + length(t) + 1 > {MAX_LINE_LENGTH} THEN length(t) ELSE acc.len + length(t) + 1 END, "
        f"'wl': acc.wl + CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AND acc.len + length(t) + 1 > {MAX_LINE_LENGTH} THEN 1 ELSE 0 END, "
        f"'cw': CASE WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN acc.cw "
        f"WHEN acc.len + length(t) + 1 > {MAX_LINE_LENGTH} THEN 1 ELSE acc.cw + 1 END}}")
    init = f"{{'a': {a0}, 'n': 0, 'w': 0, 'l': 0, 'len': -1, 'wl': 0, 'cw': 0}}"
    return f"list_reduce({tokens}, {step}, {init})"


def blocks_sql(events: str, with_owner: bool = False) -> str:
    A = DEFAULT_TAG_ACTIONS
    no_boundary = A.no_boundary()
    no_level = A.no_level_change()
    opt = list(IMPLIED_END)
    balanced = f"tag NOT IN {inlist(VOID_TAGS + tuple(opt))}"

    def delta(cond):
        return (f"CASE WHEN {cond} AND {balanced} AND kind = 'start' THEN 1 "
                f"WHEN {cond} AND {balanced} AND kind = 'end' AND NOT stray THEN -1 ELSE 0 END")

    opens = ["li_count > 0 AS open_LI"]
    for t, (sc, ec) in IMPLIED_END.items():
        if t == "LI":
            continue
        opens.append(
            f"coalesce(last_value(CASE WHEN kind = 'start' AND tag = {q(t)} THEN true "
            f"WHEN (kind = 'start' AND tag IN {inlist(sc)}) OR (kind = 'end' AND tag IN {inlist(ec)}) THEN false END "
            f"IGNORE NULLS) OVER wb, false) AS open_{t}")
    ign_bal = [t for t in A.ignorable if t not in IMPLIED_END]
    lab_tags = [t for t in A.labels if t not in IMPLIED_END]
    labs = [f"coalesce(sum({delta(f'tag = {q(t)}')}) OVER wb, 0) AS lab_{t}" for t in lab_tags]
    level = "lvl_sum + " + " + ".join("li_count" if t == "LI" else f"CAST(open_{t} AS INTEGER)"
                                      for t in opt if t not in no_level)
    lists = inlist(LIST_TAGS)
    wbp = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    li_ctes = f"""
l0 AS (
  SELECT *, coalesce(sum(CASE WHEN tag IN {lists} AND kind = 'start' THEN 1 WHEN tag IN {lists} AND kind = 'end' THEN -1 END)
    OVER (PARTITION BY doc_id ORDER BY pos {wbp}), 0) AS ld0
  FROM ({events})
), l1 AS (
  SELECT *, CASE WHEN tag = 'LI' THEN ld0 WHEN tag IN {lists} AND kind = 'start' THEN ld0 + 1
                 WHEN tag IN {lists} AND kind = 'end' THEN ld0 END AS lk,
            CASE WHEN tag = 'LI' AND kind = 'start' THEN true
                 WHEN (tag = 'LI' AND kind = 'end') OR tag IN {lists} THEN false END AS lm
  FROM l0
), l2 AS (
  SELECT *, CAST(coalesce(last_value(lm IGNORE NULLS) OVER (PARTITION BY doc_id, lk ORDER BY pos {wbp}), false) AS INTEGER) AS ob
  FROM l1
), l3 AS (
  SELECT * EXCLUDE (ld0, lk, lm, ob),
    coalesce(sum(CASE WHEN tag = 'LI' AND kind = 'start' THEN 1 - ob
                      WHEN (tag = 'LI' AND kind = 'end') OR (tag IN {lists} AND kind = 'end') THEN -ob ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos {wbp}), 0) AS li_count
  FROM l2
), l4 AS (
  SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 END)
    OVER (PARTITION BY doc_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM l3
), l5 AS (
  SELECT * EXCLUDE (run), coalesce(kind = 'end' AND run < least(0, coalesce(min(run)
    OVER (PARTITION BY doc_id, tag ORDER BY pos {wbp}), 0)), false) AS stray
  FROM l4
),"""
    label_parts = []
    for t, ls in sorted(A.labels.items()):
        cond = f"open_{t}" if t in IMPLIED_END else f"lab_{t} > 0"
        label_parts += [f"CASE WHEN {cond} THEN {q(x)} END" for x in ls]
    label_arr = f"list_sort(list_distinct(list_filter([{', '.join(label_parts)}], lambda x: x IS NOT NULL)))"
    ignorable = "(ign_sum > 0 OR open_OPTION)"
    soft = "'\ue000'"
    tnorm = f"regexp_replace(text, {q(JAVA_WHITESPACE)}, ' ', 'g')"
    core = f"regexp_replace({tnorm}, '^ +| +$', '', 'g')"
    return f"""
WITH {li_ctes}
st AS (
  SELECT *,
    {', '.join(opens)},
    coalesce(sum({delta(f'tag NOT IN {inlist(no_level)}')}) OVER wb, 0) AS lvl_sum,
    coalesce(sum({delta(f'tag IN {inlist(ign_bal)}')}) OVER wb, 0) AS ign_sum,
    coalesce(sum({delta("tag = 'BODY'")}) OVER wb, 0) AS body_sum,
    coalesce(sum({delta("tag = 'TITLE'")}) OVER wb, 0) AS title_sum,
    coalesce(last_value(CASE WHEN tag = 'A' AND kind = 'start' THEN true WHEN tag = 'A' AND kind = 'end' THEN false END
                        IGNORE NULLS) OVER wb, false) AS in_a,
    {', '.join(labs)},
    sum(CASE WHEN is_trigger THEN 1 ELSE 0 END) OVER wu AS grp
  FROM (SELECT *, coalesce(kind <> 'text' AND tag NOT IN {inlist(no_boundary)}, false) AS is_trigger FROM l5)
  WINDOW wb AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wu AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), opening AS (
  SELECT *, coalesce((kind = 'start' AND tag NOT IN {inlist(HEAD_TAGS + A.body)})
                     OR (kind = 'text' AND NOT {ignorable} AND title_sum = 0 AND {core} <> ''), false) AS opens,
    bool_or(kind = 'start' AND tag = 'BODY') OVER (PARTITION BY doc_id) AS has_body
  FROM st
), bodied AS (
  SELECT *, NOT has_body AND bool_or(opens) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS implied_body
  FROM opening
), ev0 AS (
  SELECT doc_id, pos, grp, is_trigger, in_a,
    CASE WHEN is_trigger THEN grp - 1 ELSE grp END AS owner,
    body_sum > 0 OR implied_body AS in_body,
    CASE WHEN kind IN ('start', 'end') AND tag = 'A' AND NOT {ignorable} THEN {soft}
         WHEN kind IN ('start', 'end') AND tag IN ('ABBR', 'ACRONYM') THEN {soft}
         WHEN kind <> 'text' OR {ignorable} THEN NULL
         WHEN {core} = '' THEN {soft}
         ELSE CASE WHEN starts_with({tnorm}, ' ') THEN {soft} ELSE '' END || {core}
              || CASE WHEN suffix({tnorm}, ' ') THEN {soft} ELSE '' END END AS tp,
    CASE WHEN kind = 'start' AND tag = 'A' AND NOT {ignorable} THEN {soft} || '\ue00a' || {soft}
         WHEN kind = 'end' AND tag = 'A' AND NOT {ignorable} THEN {soft} || '\ue00b' || {soft} END AS marker,
    CASE WHEN kind = 'text' AND NOT {ignorable} AND {core} <> '' THEN {level} + CAST(implied_body AS INTEGER) END AS core_level,
    CASE WHEN kind = 'text' OR kind = 'end' OR (kind = 'start' AND tag = 'BODY') THEN {label_arr} END AS exec_labels
  FROM bodied
), ev AS (
  SELECT *, coalesce(marker, tp) AS kp,
    first_value(exec_labels IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS labels_at,
    first_value(core_level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS doc_level
  FROM ev0
), g AS (
  SELECT doc_id, owner,
    coalesce(string_agg(tp, '' ORDER BY pos) FILTER (WHERE tp IS NOT NULL), '') AS tbuf,
    coalesce(string_agg(kp, '' ORDER BY pos) FILTER (WHERE tp IS NOT NULL), '') AS kbuf,
    arg_min(in_a, pos) FILTER (WHERE tp IS NOT NULL) AS a0,
    arg_min(core_level, pos) FILTER (WHERE core_level IS NOT NULL) AS level0,
    bool_or(in_body) FILTER (WHERE tp IS NOT NULL) AS in_body,
    max(labels_at) FILTER (WHERE is_trigger) AS labels,
    any_value(doc_level) AS doc_level
  FROM ev GROUP BY doc_id, owner
), c AS (
  SELECT doc_id, owner, labels, level0, doc_level,
    regexp_replace(regexp_replace(tbuf, '\ue000+', ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS text,
    {counts_sql(tokens_sql("regexp_replace(kbuf, '\ue000+', ' ', 'g')"), 'coalesce(a0, false)')} AS c
  FROM g WHERE in_body
), b AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY owner) - 1 AS INTEGER) AS block_idx, text,
    CAST(c.w AS INTEGER) AS num_words, CAST(c.l AS INTEGER) AS num_anchor_words,
    CAST(CASE WHEN (CASE WHEN c.wl = 0 THEN c.w ELSE c.w - c.cw END) = 0 THEN c.w
              ELSE (CASE WHEN c.wl = 0 THEN c.w ELSE c.w - c.cw END) END AS INTEGER) AS num_words_wrapped,
    CAST(CASE WHEN c.wl = 0 OR c.w - c.cw = 0 THEN 1 ELSE c.wl END AS INTEGER) AS num_wrapped_lines,
    level0, doc_level, coalesce(labels, []::VARCHAR[]) AS labels, owner
  FROM c WHERE c.n > 0
)
SELECT doc_id, block_idx, text, num_words, num_anchor_words, num_words_wrapped, num_wrapped_lines,
  CAST(num_words_wrapped AS DOUBLE) / num_wrapped_lines AS text_density,
  CASE WHEN num_words = 0 THEN 0.0 ELSE CAST(num_anchor_words AS DOUBLE) / num_words END AS link_density,
  block_idx AS offset_start, block_idx AS offset_end,
  CAST(CASE WHEN block_idx = 0 THEN doc_level ELSE level0 END AS INTEGER) AS tag_level,
  labels, false AS is_content, [block_idx] AS members{", owner" if with_owner else ""}
FROM b"""


def docs_sql(events: str) -> str:
    return f"""
WITH st AS (
  SELECT *,
    coalesce(sum(CASE WHEN tag = 'TITLE' AND kind = 'start' THEN 1 WHEN tag = 'TITLE' AND kind = 'end' THEN -1 END) OVER wb, 0) AS in_title,
    coalesce(sum(CASE WHEN tag = 'BODY' AND kind = 'start' THEN 1 WHEN tag = 'BODY' AND kind = 'end' THEN -1 END) OVER wb, 0) AS in_body
  FROM ({events})
  WINDOW wb AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT doc_id,
    regexp_replace(regexp_replace(arg_min(text, pos), {q(JAVA_WHITESPACE)}, ' ', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS title
  FROM st WHERE kind = 'text' AND in_title > 0 AND in_body <= 0 GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN t.title <> '' THEN t.title END AS title
FROM (SELECT DISTINCT doc_id FROM ({events})) d LEFT JOIN t USING (doc_id)"""


EVENTS = events_sql()


def anchors_in_block_sql(events: str, anchors: str) -> str:
    """Anchors joined to the block holding their last text run."""
    no_boundary = DEFAULT_TAG_ACTIONS.no_boundary()
    return f"""
WITH st AS (
  SELECT doc_id, pos, kind,
    sum(CASE WHEN kind <> 'text' AND tag NOT IN {inlist(no_boundary)} THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner,
    CAST(sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_idx
  FROM ({events})
), eb AS (
  SELECT st.doc_id, st.run_idx, b.block_idx FROM st JOIN ({blocks_sql(events, with_owner=True)}) b
    ON st.doc_id = b.doc_id AND st.owner = b.owner WHERE st.kind = 'text'
)
SELECT a.doc_id, eb.block_idx, a.anchor_no, a.run_idx, a.anchor_text, a.href
FROM ({anchors}) a JOIN eb ON a.doc_id = eb.doc_id AND a.run_idx = eb.run_idx"""
BLOCKS = blocks_sql(EVENTS)
DOCS = docs_sql(EVENTS)
