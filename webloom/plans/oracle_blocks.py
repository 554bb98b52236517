"""DuckDB oracle SQL for block classifiers, fusion and extractors.

Each step turns a relation name into a SELECT over it; ``chain`` stacks steps
as CTEs on top of the blocks oracle.
"""

from __future__ import annotations

from webloom.operators import classifiers as C
from webloom.plans.oracle_html import q

COLS = ", ".join(C.BLOCK_COLUMNS)
W = "WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)"
JTRIM = "regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def jtrim(x: str) -> str:
    return JTRIM.format(x=x)


def add_label(label: str, cond: str = "true") -> str:
    return f"CASE WHEN {cond} THEN list_sort(list_distinct(list_append(labels, {q(label)}))) ELSE labels END"


def has(label: str) -> str:
    return f"list_contains(labels, {q(label)})"


def chain(base: str, *steps, extra: tuple = ()) -> str:
    ctes = [f"s0 AS ({base})"]
    for i, st in enumerate(steps, 1):
        ctes.append(f"s{i} AS ({st(f's{i - 1}')})")
    cols = ", ".join((COLS,) + tuple(extra))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {cols} FROM s{len(steps)}"


NB = ("coalesce(lag(link_density) OVER w, 0) AS p_ld, coalesce(lag(num_words) OVER w, 0) AS p_w, "
      "coalesce(lag(text_density) OVER w, 0) AS p_td, coalesce(lead(link_density) OVER w, 0) AS n_ld, "
      "coalesce(lead(num_words) OVER w, 0) AS n_w, coalesce(lead(text_density) OVER w, 0) AS n_td")


def f1(src):
    return f"""SELECT * REPLACE (CASE WHEN link_density > 0.333333 THEN false
      WHEN p_ld <= 0.555556 THEN (CASE WHEN num_words > 16 THEN true WHEN n_w > 15 THEN true ELSE p_w > 4 END)
      ELSE (CASE WHEN num_words > 40 THEN true ELSE n_w > 17 END) END AS is_content)
    FROM (SELECT *, {NB} FROM {src} {W})"""


def f2(src):
    return f"""SELECT * REPLACE (CASE WHEN link_density > 0.333333 THEN false
      WHEN p_ld <= 0.555556 THEN (CASE WHEN text_density <= 9 THEN (CASE WHEN n_td > 10 THEN true ELSE p_td > 4 END)
                                       ELSE n_td <> 0 END)
      ELSE n_td > 11 END AS is_content)
    FROM (SELECT *, {NB} FROM {src} {W})"""


def f3(src):
    return f"""SELECT * REPLACE (((link_density > 0 AND n_w > 11) OR num_words > 19 OR
      (n_w > 6 AND n_ld = 0 AND p_ld = 0 AND (num_words > 6 OR p_w > 7 OR n_w > 19))) AS is_content)
    FROM (SELECT *, {NB} FROM {src} {W})"""


def f5(src):
    lc = f"lower({jtrim('text')})"
    hits = ([f"starts_with({lc}, {q(s)})" for s in C.END_STARTS]
            + [f"regexp_matches({lc}, {q('^[0-9]+' + s)})" for s in C.END_NUMBER_STARTS]
            + [f"contains({lc}, {q(s)})" for s in C.END_CONTAINS] + [f"{lc} = {q(s)}" for s in C.END_EQUALS])
    ln = f"length({jtrim('text')})"
    cond = (f"num_words < 15 AND (({ln} >= 8 AND ({' OR '.join(hits)})) OR "
            f"({ln} < 8 AND link_density = 1.0 AND {jtrim('text')} = 'Comment'))")
    return f"SELECT * REPLACE ({add_label(C.INDICATES_END_OF_TEXT, cond)} AS labels) FROM {src}"


FT = "CASE WHEN text_density >= 9 THEN num_words ELSE 0 END"


def f6(src, min_words=60):
    return f"""SELECT * REPLACE (is_content AND NOT coalesce(bool_or(flag) OVER (PARTITION BY doc_id ORDER BY block_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_content)
    FROM (SELECT *, {has(C.INDICATES_END_OF_TEXT)} AND sum(CASE WHEN is_content THEN {FT} ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {min_words} AS flag
      FROM {src})"""


def f7(src):
    end = has(C.INDICATES_END_OF_TEXT)
    return f"""SELECT * REPLACE (
        CASE WHEN hit THEN list_sort(list_filter(list_distinct(list_append(labels, {q(C.STRICTLY_NOT_CONTENT)})),
                                                 lambda x: x <> {q(C.MIGHT_BE_CONTENT)})) ELSE labels END AS labels,
        is_content AND NOT hit AS is_content)
    FROM (SELECT *, {end} AND coalesce(sum(CASE WHEN is_content AND NOT {end} THEN num_words END)
        OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= 200 AS hit
      FROM {src})"""


def f8(src):
    return f"""SELECT * REPLACE (CASE WHEN active THEN block_idx = li ELSE is_content END AS is_content,
        CASE WHEN active AND block_idx <> li THEN list_sort(list_distinct(list_append(labels, {q(C.MIGHT_BE_CONTENT)})))
             ELSE labels END AS labels)
    FROM (SELECT *, n >= 2 AND li IS NOT NULL AS active FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id) AS n,
        first_value(CASE WHEN is_content THEN block_idx END IGNORE NULLS) OVER (PARTITION BY doc_id
          ORDER BY (CASE WHEN is_content THEN {FT} END) DESC NULLS LAST, block_idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS li
      FROM {src}))"""


def f9(src, k=30):
    return f"SELECT * REPLACE (is_content AND {FT} >= {k} AS is_content) FROM {src}"


def f10(src, k=5):
    return f"SELECT * REPLACE (is_content AND num_words >= {k} AS is_content) FROM {src}"


def f11(src, k=5):
    pieces = ("string_split(regexp_replace(text, '([\\p{L}0-9])[,.:;!?]+([ \\n\\r]+|$)', '\\1\ue001', 'g'), '\ue001')")
    return f"""SELECT * REPLACE (is_content AND coalesce(list_bool_or(list_transform(list_slice(pc, 1, len(pc) - 1),
        lambda p: len(string_split_regex(p, '[ \\n\\r]+')) >= {k})), false) AS is_content)
    FROM (SELECT *, {pieces} AS pc FROM {src})"""


def f12(src, labels=(C.TITLE,)):
    arr = "[" + ", ".join(q(x) for x in labels) + "]"
    return f"SELECT * REPLACE (is_content OR list_has_any(labels, {arr}) AS is_content) FROM {src}"


def f13(src, labels=(C.STRICTLY_NOT_CONTENT,)):
    arr = "[" + ", ".join(q(x) for x in labels) + "]"
    return f"SELECT * REPLACE (is_content AND NOT list_has_any(labels, {arr}) AS is_content) FROM {src}"


def f14(src):
    return f"SELECT * REPLACE (true AS is_content) FROM {src}"


def f15(src):
    return f"SELECT * REPLACE (false AS is_content) FROM {src}"


def f16(src):
    return f"SELECT * REPLACE (NOT is_content AS is_content) FROM {src}"


def f17(src, keep_title=True):
    keep = f" OR {has(C.TITLE)}" if keep_title else ""
    return f"SELECT * FROM {src} WHERE is_content{keep}"


def f18(src):
    return f"""SELECT * REPLACE (is_content OR (NOT is_content AND coalesce(pc, false) AND coalesce(nc, false)
        AND link_density = 0 AND num_words > 6 AND n >= 3 AND pos % 2 = 1) AS is_content)
    FROM (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n,
      lag(is_content) OVER w AS pc, lead(is_content) OVER w AS nc FROM {src} {W})"""


def f19(src):
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, p) - 1 AS INTEGER) AS block_idx,
        t AS text,
        CASE WHEN sp THEN 0 ELSE num_words END AS num_words, CASE WHEN sp THEN 0 ELSE num_anchor_words END AS num_anchor_words,
        CASE WHEN sp THEN 0 ELSE num_words_wrapped END AS num_words_wrapped,
        CASE WHEN sp THEN 1 ELSE num_wrapped_lines END AS num_wrapped_lines,
        CASE WHEN sp THEN 0.0 ELSE text_density END AS text_density, CASE WHEN sp THEN 0.0 ELSE link_density END AS link_density,
        CASE WHEN sp THEN 0 ELSE offset_start END AS offset_start, CASE WHEN sp THEN 0 ELSE offset_end END AS offset_end,
        CASE WHEN sp THEN 0 ELSE tag_level END AS tag_level, labels, is_content, members
    FROM (SELECT *, unnest(parts) AS t, generate_subscripts(parts, 1) AS p FROM (
      SELECT *, len(string_split_regex(text, '[\\n\\r]+')) >= 2 AS sp,
        CASE WHEN len(string_split_regex(text, '[\\n\\r]+')) >= 2 THEN string_split_regex(text, '[\\n\\r]+') ELSE [text] END AS parts
      FROM {src}))"""


def f20(src, docs):
    t = f"lower({jtrim(f'replace(replace(title, {q(chr(160))}, {q(chr(32))}), {q(chr(39))}, {q(chr(39) * 0)})')})"

    def jsplit(s, pat):
        parts = f"string_split_regex({s}, {q(pat)})"
        rev_first = f"list_position(list_reverse(list_transform({parts}, lambda x: x <> '')), true)"
        keep = f"CASE WHEN {rev_first} IS NULL THEN 0 ELSE len({parts}) - {rev_first} + 1 END"
        return f"(CASE WHEN {s} = '' THEN [''] ELSE list_slice({parts}, 1, {keep}) END)"

    def nwords(p):
        return f"len({jsplit(p, '[' + chr(8) + ' ]+')})"

    def longest(pat):
        parts = jsplit("tt", pat)
        step = (f"lambda acc, p: CASE WHEN NOT contains(p, '.com') AND ({nwords('p')} > acc.n OR length(p) > length(acc.p)) "
                f"THEN {{'n': {nwords('p')}, 'p': p}} ELSE acc END")
        best = f"list_reduce({parts}, {step}, {{'n': 0, 'p': ''}})"
        return f"CASE WHEN len({parts}) <> 1 AND ({best}).p <> '' THEN {jtrim(f'({best}).p')} END"

    def minw(pat, k):
        parts = jsplit("tt", pat)
        return f"CASE WHEN len({parts}) <> 1 THEN list_filter({parts}, lambda p: NOT contains(p, '.com') AND {nwords('p')} >= {k}) ELSE []::VARCHAR[] END"

    pats = ["[ ]*[\\|»|-][ ]*", "[ ]*[\\|»|:][ ]*", "[ ]*[\\|»|:\\(\\)][ ]*", "[ ]*[\\|»|:\\(\\)\\-][ ]*",
            "[ ]*[\\|»|,|:\\(\\)\\-][ ]*", "[ ]*[\\|»|,|:\\(\\)\\-" + chr(160) + "][ ]*"]
    singles = ["tt"] + [longest(p) for p in pats] + [
        "regexp_replace(tt, ' - [^\\-]+$', '')", "regexp_replace(tt, '^[^\\-]+ - ', '')"]
    cands = (f"list_sort(list_distinct(list_concat(list_filter([{', '.join(singles)}], lambda x: x IS NOT NULL), "
             f"{minw('[ ]+[\\|][ ]+', 4)}, {minw('[ ]+[\\-][ ]+', 4)})))")
    t1 = f"lower({jtrim(f'replace(replace(text, {q(chr(160))}, {q(chr(32))}), {q(chr(39))}, {q(chr(39) * 0)})')})"
    t2 = jtrim(f"regexp_replace({t1}, '[\\?\\!\\.\\-\\:]+', '', 'g')")
    return f"""SELECT * REPLACE ({add_label(C.TITLE, 'block_idx = first_m')} AS labels) FROM (
      SELECT *, min(CASE WHEN m THEN block_idx END) OVER (PARTITION BY doc_id) AS first_m FROM (
        SELECT b.*, coalesce(list_contains(c.cands, {t1}) OR list_contains(c.cands, {t2}), false) AS m
        FROM {src} b LEFT JOIN (
          SELECT doc_id, CASE WHEN title IS NULL OR tt = '' THEN NULL ELSE {cands} END AS cands
          FROM (SELECT doc_id, title, {t} AS tt FROM ({docs}))) c USING (doc_id)))"""


def f21(src, expand=True, min_words=150):
    content = "block_idx = li"
    if expand:
        content = (f"block_idx = li OR (li IS NOT NULL AND block_idx > coalesce(pl, -1) AND block_idx < coalesce(nl, 2147483647) "
                   f"AND tag_level = lvl AND num_words >= {min_words})")
    return f"""SELECT * REPLACE (CASE WHEN n >= 2 THEN coalesce({content}, false) ELSE is_content END AS is_content,
        CASE WHEN n < 2 THEN labels WHEN coalesce(block_idx = li, false)
             THEN list_sort(list_distinct(list_append(labels, {q(C.VERY_LIKELY_CONTENT)})))
             ELSE list_sort(list_distinct(list_append(labels, {q(C.MIGHT_BE_CONTENT)}))) END AS labels)
    FROM (SELECT *,
        max(CASE WHEN tag_level < lvl AND block_idx < li THEN block_idx END) OVER (PARTITION BY doc_id) AS pl,
        min(CASE WHEN tag_level < lvl AND block_idx > li THEN block_idx END) OVER (PARTITION BY doc_id) AS nl
      FROM (SELECT *, max(CASE WHEN block_idx = li THEN tag_level END) OVER (PARTITION BY doc_id) AS lvl FROM (
        SELECT *, count(*) OVER (PARTITION BY doc_id) AS n,
          first_value(CASE WHEN is_content THEN block_idx END IGNORE NULLS) OVER (PARTITION BY doc_id
            ORDER BY (CASE WHEN is_content THEN num_words END) DESC NULLS LAST, block_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS li
        FROM {src})))"""


def f22(src):
    return f"""SELECT * REPLACE (is_content OR coalesce(ti IS NOT NULL AND fc IS NOT NULL AND fc > ti AND block_idx >= ti
        AND block_idx < fc AND {has(C.MIGHT_BE_CONTENT)}, false) AS is_content)
    FROM (SELECT *, max(CASE WHEN {has(C.TITLE)} AND (fc IS NULL OR block_idx <= fc) THEN block_idx END)
        OVER (PARTITION BY doc_id) AS ti
      FROM (SELECT *, min(CASE WHEN is_content THEN block_idx END) OVER (PARTITION BY doc_id) AS fc FROM {src}))"""


def f23(src):
    return f"""SELECT * REPLACE (is_content OR coalesce(NOT is_content AND num_words >= 100 AND tag_level = lvl, false) AS is_content)
    FROM (SELECT *, first_value(CASE WHEN is_content AND {has(C.VERY_LIKELY_CONTENT)} THEN tag_level END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lvl
      FROM {src})"""


def f24(src):
    up = "OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT * REPLACE (is_content OR (ok AND (lf IS NULL OR lf < ai)) AS is_content)
    FROM (SELECT *, max(CASE WHEN NOT a AND NOT ok THEN block_idx END) {up} AS lf FROM (
      SELECT *, coalesce(NOT a AND al IS NOT NULL AND tag_level > al AND {has(C.MIGHT_BE_CONTENT)} AND {has(C.LI)}
          AND link_density = 0, false) AS ok FROM (
        SELECT *, is_content AND {has(C.VERY_LIKELY_CONTENT)} AS a,
          last_value(CASE WHEN is_content AND {has(C.VERY_LIKELY_CONTENT)} THEN tag_level END IGNORE NULLS) {up} AS al,
          last_value(CASE WHEN is_content AND {has(C.VERY_LIKELY_CONTENT)} THEN block_idx END IGNORE NULLS) {up} AS ai
        FROM {src})))"""


def f25(src):
    return f"""SELECT * REPLACE (is_content AND NOT (is_content AND {has(C.HEADING)} AND (lp IS NULL OR block_idx > lp)) AS is_content)
    FROM (SELECT *, max(CASE WHEN is_content AND NOT {has(C.HEADING)} THEN block_idx END) OVER (PARTITION BY doc_id) AS lp
      FROM {src})"""


def f26(src):
    hit = " OR ".join(f"regexp_matches(text, {q(p)})" for p in C.METADATA_PATTERNS)
    cond = f"num_words <= 10 AND ({hit})"
    return f"""SELECT * REPLACE (is_content OR ({cond}) AS is_content, {add_label(C.ARTICLE_METADATA, cond)} AS labels)
    FROM {src}"""


def f27(src, prefix=""):
    return f"""SELECT * REPLACE (CASE WHEN pos >= 2 THEN list_sort(list_distinct(list_concat(labels,
        list_transform(coalesce(pl, []::VARCHAR[]), lambda x: {q(prefix)} || x)))) ELSE labels END AS labels)
    FROM (SELECT *, row_number() OVER w - 1 AS pos, lag(labels) OVER w AS pl FROM {src} {W})"""


# ------------------------------------------------------------------ fusion

def fuse(src, join_expr_sql):
    """join_expr_sql: SELECT over src adding boolean column j (joins previous)."""
    return f"""SELECT doc_id, block_idx, text, num_words, num_anchor_words,
        CASE WHEN ww = 0 THEN num_words ELSE ww END AS num_words_wrapped,
        CASE WHEN ww = 0 THEN 1 ELSE wl END AS num_wrapped_lines,
        CAST(CASE WHEN ww = 0 THEN num_words ELSE ww END AS DOUBLE) / (CASE WHEN ww = 0 THEN 1 ELSE wl END) AS text_density,
        CASE WHEN num_words = 0 THEN 0.0 ELSE CAST(num_anchor_words AS DOUBLE) / num_words END AS link_density,
        offset_start, offset_end, tag_level, labels, is_content, members
    FROM (SELECT doc_id, g, min(block_idx) AS block_idx, string_agg(text, chr(10) ORDER BY block_idx) AS text,
        list_sort(flatten(list(members))) AS members,
        CAST(sum(num_words) AS INTEGER) AS num_words, CAST(sum(num_anchor_words) AS INTEGER) AS num_anchor_words,
        CAST(sum(num_words_wrapped) AS INTEGER) AS ww, CAST(sum(num_wrapped_lines) AS INTEGER) AS wl,
        min(offset_start) AS offset_start, max(offset_end) AS offset_end, min(tag_level) AS tag_level,
        list_sort(list_distinct(flatten(list(labels)))) AS labels, bool_or(is_content) AS is_content
      FROM (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ({join_expr_sql}))
      GROUP BY doc_id, g)"""


def g1(src, dist=1, content_only=False, same_level=False):
    j = f"is_content AND pe IS NOT NULL AND offset_start - pe - 1 <= {dist}"
    if content_only:
        j += " AND pc"
    if same_level:
        j += " AND tag_level = pl"
    inner = (f"SELECT *, coalesce({j}, false) AS j FROM (SELECT *, lag(offset_end) OVER w AS pe, "
             f"lag(is_content) OVER w AS pc, lag(tag_level) OVER w AS pl FROM {src} {W})")
    return fuse(src, inner)


def g2(src):
    inner = f"SELECT *, coalesce(lag(text_density) OVER w = text_density, false) AS j FROM {src} {W}"
    return fuse(src, inner)


def g3(src):
    mk = "list_sort(list_filter({x}, lambda l: starts_with(l, '<')))"
    inner = (f"SELECT *, coalesce(len(pl) > 0 AND len(labels) > 0 AND {mk.format(x='pl')} = {mk.format(x='labels')}, false) AS j "
             f"FROM (SELECT *, lag(labels) OVER w AS pl FROM {src} {W})")
    return fuse(src, inner)


def g4(src):
    up = "OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = f"""SELECT *, coalesce(ok AND NOT fst AND plc IS NOT NULL AND plc >= plh, false) AS j FROM (
      SELECT *, lag(lc) OVER w AS plc, lag(lh) OVER w AS plh FROM (
        SELECT *, max(CASE WHEN is_content THEN block_idx END) {up} AS lc,
          max(CASE WHEN NOT ok OR fst THEN block_idx END) {up} AS lh FROM (
          SELECT *, link_density < 0.56 AND NOT {has(C.STRICTLY_NOT_CONTENT)} AS ok, row_number() OVER w = 1 AS fst
          FROM {src} {W}) {W}) {W})"""
    return fuse(src, inner)


# ------------------------------------------------------------------ extractors

def article_steps(docs):
    return [f5, lambda s: f20(s, docs), f1, f6, f25, lambda s: g1(s), lambda s: f17(s, True),
            lambda s: g1(s, 1, True, True), lambda s: f21(s, True, 150), f22, f23, f24]


def content_text_sql(blocks_sql: str, docs: str) -> str:
    return f"""SELECT d.doc_id, d.title, coalesce(t.text, '') AS text FROM ({docs}) d LEFT JOIN (
      SELECT doc_id, string_agg(text || chr(10), '' ORDER BY block_idx) AS text FROM ({blocks_sql})
      WHERE is_content GROUP BY doc_id) t USING (doc_id)"""
