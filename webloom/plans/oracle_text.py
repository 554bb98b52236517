"""DuckDB oracle SQL for text cleaning, stemming and vectors.

RE2 has no look-arounds, so joining punctuation inside tokens is marked with
capture-group passes first; the Porter steps are DuckDB list lambdas; the
ASCII folding tables come from the same Unicode database rule.
"""

from __future__ import annotations

from webloom.functions import cleaning as T
from webloom.functions import stem as S
from webloom.functions.fold import fold_tables
from webloom.plans.oracle_html import q

MARK = "\ue020"


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in T.stop_words()) + "]"


def analyzer_tokens_sql(x: str) -> str:
    s = x
    for _ in range(2):
        s = f"regexp_replace({s}, '([\\p{{L}}\\p{{M}}])([''.:’‘·])(\\p{{L}})', '\\1{MARK}\\2\\3', 'g')"
    for _ in range(2):
        s = f"regexp_replace({s}, '(\\p{{Nd}})([.,;''’‘])(\\p{{Nd}})', '\\1{MARK}\\2\\3', 'g')"
    tok = (f"'[\\p{{Han}}\\p{{Hiragana}}]|(?:[^\\P{{L}}\\p{{Han}}\\p{{Hiragana}}]|[\\p{{M}}\\p{{Nd}}_]|{MARK}.)+'")
    raw = f"list_transform(regexp_extract_all({s}, {tok}), lambda t: replace(t, '{MARK}', ''))"
    return (f"list_filter({raw}, lambda t: "
            f"regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))")


def _shape(t: str) -> str:
    return (f"list_reduce(string_split({t}, ''), lambda acc, ch: acc || CASE WHEN ch IN ('a','e','i','o','u') THEN 'v' "
            f"WHEN ch = 'y' THEN (CASE WHEN acc = '' OR suffix(acc, 'v') THEN 'c' ELSE 'v' END) ELSE 'c' END, '')")


def _m(s: str, n: str) -> str:
    x = f"left({s}, {n})"
    return f"((length({x}) - length(replace({x}, 'vc', ''))) // 2)"


def _vowel(s: str, n: str) -> str:
    return f"contains(left({s}, {n}), 'v')"


def _cvc(w: str, s: str, i: str) -> str:
    return f"({i} >= 2 AND substring({s}, {i} - 1, 3) = 'cvc' AND substring({w}, {i} + 1, 1) NOT IN ('w','x','y'))"


def _dbl(w: str, s: str) -> str:
    return f"(length({w}) >= 2 AND right({w}, 1) = substring({w}, length({w}) - 1, 1) AND right({s}, 1) = 'c')"


def _cut(w: str, k) -> str:
    return f"left({w}, length({w}) - {k})"


def _step(arr: str, body: str) -> str:
    """body uses x.w / x.s; short words stay."""
    return (f"list_transform(list_transform({arr}, lambda t: {{'w': t, 's': {_shape('t')}}}), "
            f"lambda x: CASE WHEN length(x.w) <= 2 THEN x.w ELSE {body} END)")


def porter_sql(arr: str) -> str:
    w, s, n = "x.w", "x.s", "length(x.w)"
    a = (f"list_transform({arr}, lambda t: CASE WHEN length(t) <= 2 THEN t WHEN suffix(t, 'sses') THEN {_cut('t', 2)} "
         f"WHEN suffix(t, 'ies') THEN {_cut('t', 3)} || 'i' WHEN suffix(t, 's') AND NOT suffix(t, 'ss') THEN {_cut('t', 1)} "
         f"ELSE t END)")

    def after(stem: str) -> str:
        ln = f"length({stem})"
        st = f"left({s}, {ln})"
        return (f"(CASE WHEN suffix({stem}, 'at') OR suffix({stem}, 'bl') OR suffix({stem}, 'iz') THEN {stem} || 'e' "
                f"WHEN {_dbl(stem, st)} THEN (CASE WHEN right({stem}, 1) IN ('l','s','z') THEN {stem} ELSE {_cut(stem, 1)} END) "
                f"WHEN {_m(st, ln)} = 1 AND {_cvc(stem, st, ln + ' - 1')} THEN {stem} || 'e' ELSE {stem} END)")

    b1 = (f"CASE WHEN suffix({w}, 'eed') THEN (CASE WHEN {_m(s, n + ' - 3')} > 0 THEN {_cut(w, 1)} ELSE {w} END) "
          f"WHEN suffix({w}, 'ed') THEN (CASE WHEN {_vowel(s, n + ' - 2')} THEN {after(_cut(w, 2))} ELSE {w} END) "
          f"WHEN suffix({w}, 'ing') THEN (CASE WHEN {_vowel(s, n + ' - 3')} THEN {after(_cut(w, 3))} ELSE {w} END) "
          f"ELSE {w} END")
    c1 = f"CASE WHEN suffix({w}, 'y') AND {_vowel(s, n + ' - 1')} THEN {_cut(w, 1)} || 'i' ELSE {w} END"

    def rules(rs, min_m):
        parts = [f"WHEN suffix({w}, {q(suf)}) THEN (CASE WHEN {_m(s, f'{n} - {len(suf)}')} > {min_m} "
                 f"THEN {_cut(w, len(suf))} || {q(rep)} ELSE {w} END)" for suf, rep in rs]
        return "CASE " + " ".join(parts) + f" ELSE {w} END"

    parts4 = []
    for suf in S.STEP4:
        cond = f"{_m(s, f'{n} - {len(suf)}')} > 1"
        if suf == "ion":
            cond = f"{n} >= 4 AND substring({w}, {n} - 3, 1) IN ('s','t') AND " + cond
        parts4.append(f"WHEN suffix({w}, {q(suf)}) THEN (CASE WHEN {cond} THEN {_cut(w, len(suf))} ELSE {w} END)")
    d4 = "CASE " + " ".join(parts4) + f" ELSE {w} END"
    m5 = _m(s, n)
    drop_e = f"(suffix({w}, 'e') AND ({m5} > 1 OR ({m5} = 1 AND NOT {_cvc(w, s, n + ' - 2')})))"
    w2 = f"(CASE WHEN {drop_e} THEN {_cut(w, 1)} ELSE {w} END)"
    s2 = f"(CASE WHEN {drop_e} THEN {_cut(s, 1)} ELSE {s} END)"
    e5 = (f"CASE WHEN suffix({w2}, 'l') AND {_dbl(w2, s2)} AND {_m(s2, f'length({w2})')} > 1 THEN {_cut(w2, 1)} "
          f"ELSE {w2} END")
    for body in (b1, c1, rules(S.STEP2, 0), rules(S.STEP3, 0), d4, e5):
        a = _step(a, body)
    return a


def fold_sql(x: str) -> str:
    src, dst, multi = fold_tables()
    cls = "[" + "".join(multi) + "]"
    mp = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(multi.items())) + "}"
    expanded = (f"CASE WHEN regexp_matches({x}, {q(cls)}) THEN array_to_string(list_transform(string_split({x}, ''), "
                f"lambda c: coalesce({mp}[c], c)), '') ELSE {x} END")
    return f"regexp_replace(translate({expanded}, {q(src)}, {q(dst)}), '[^\\x00-\\x7F]', '', 'g')"


def remove_urls_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(T.URL_RE)}, '', 'g')"


def remove_numbers_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(T.NUMBER_RE)}, '', 'g')"


def analyze_sql(x: str, stem: bool = True) -> str:
    toks = f"list_transform({analyzer_tokens_sql(x)}, lambda t: lower(regexp_replace(t, '[''’＇][sS]$', '')))"
    toks = f"list_filter({toks}, lambda t: NOT list_contains({stop_list()}, t))"
    return porter_sql(toks) if stem else toks


def strip_symbols_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9 ]+', '', 'g'), '\\s+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return strip_symbols_sql(fold_sql(f"array_to_string({analyze_sql(remove_numbers_sql(remove_urls_sql(x)))}, ' ')"))


CLEAN_DOCS = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {clean_sql('text')} AS text FROM documents"


def term_counts_sql(stem: bool = False) -> str:
    toks = "string_split(regexp_replace(text, '\\n$', ''), ' ')"
    return f"""
  SELECT doc_id, term, count(*) AS count FROM (
    SELECT doc_id, unnest(list_filter({porter_sql(toks) if stem else toks}, lambda t: t <> '')) AS term
    FROM ({CLEAN_DOCS})) GROUP BY doc_id, term"""


def vocab_sql(counts: str) -> str:
    return f"""
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id
  FROM (SELECT DISTINCT term FROM ({counts}))"""


def doc_terms_sql(counts: str) -> str:
    return f"SELECT c.doc_id, v.term_id, c.count FROM ({counts}) c JOIN ({vocab_sql(counts)}) v USING (term)"


def doc_vectors_sql(counts: str) -> str:
    return f"""
  SELECT doc_id, string_agg(CAST(term_id AS VARCHAR) || ':' || CAST(count AS VARCHAR), ' ' ORDER BY term_id) AS vector
  FROM ({doc_terms_sql(counts)}) GROUP BY doc_id"""


TERM_COUNTS = term_counts_sql()
VOCAB = vocab_sql(TERM_COUNTS)
DOC_TERMS = doc_terms_sql(TERM_COUNTS)
DOC_VECTORS = doc_vectors_sql(TERM_COUNTS)
