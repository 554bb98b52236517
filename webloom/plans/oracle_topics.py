"""DuckDB oracle SQL for the topic model: E-step, M-step and Newton steps as recursive queries.

Numbers of topics, iterations and constants are those of the reference job.
"""

from __future__ import annotations

from webloom.plans.oracle_text import DOC_TERMS, VOCAB

K, INNER, ALPHA0, ETA = 10, 100, 0.1, 1e-12


def digamma_sql(x: str) -> str:
    y, f = f"({x} + 6)", f"(1 / (({x} + 6) * ({x} + 6)))"
    shift = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return (f"(ln({y}) - 0.5 / {y} - {f} * (1.0/12 - {f} * (1.0/120 - {f} * (1.0/252 - {f} * (1.0/240 - {f} * (1.0/132))))) "
            f"- ({shift}))")


def trigamma_sql(x: str) -> str:
    y, f = f"({x} + 6)", f"(1 / (({x} + 6) * ({x} + 6)))"
    shift = " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(6))
    return f"(1 / {y} + {f} / 2 + {f} / {y} * (1.0/6 - {f} * (1.0/30 - {f} * (1.0/42 - {f} * (1.0/30)))) + {shift})"


def _uniform(salt: int) -> str:
    h = f"((2 * (term_id * {K} + k) + {salt + 2654435769}) & 4294967295)"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * 73244475) & 4294967295)"
    return f"((xor({h}, {h} >> 16) + 1) / 4294967296.0::DOUBLE)"


def _each(expr: str) -> str:
    """A list of ``expr`` for the topics 1 to K, with {k} as the topic."""
    return "[" + ", ".join(expr.format(k=k) for k in range(1, K + 1)) + "]"


def _em(prior: str, lam: str, alpha: str, n: int) -> str:
    """One E-step from topic rows (term_id, lam) and a Dirichlet parameter (one row, list a): tables g, s and u with suffix ``n``."""
    psi = digamma_sql("x::DOUBLE")
    return f"""{prior}
c{n} AS MATERIALIZED (SELECT doc_id, term_id, count::DOUBLE AS count, lam FROM dt JOIN {lam} USING (term_id)),
g{n}(it, doc_id, gamma) AS (
  SELECT 0, doc_id, list_transform(range({K}), lambda x: {ALPHA0} + (size // {K})::DOUBLE) FROM (SELECT DISTINCT doc_id FROM dt), v
  UNION ALL
  SELECT it + 1, doc_id, {_each('any_value(a[{k}]) + any_value(w[{k}]) * sum(r * lam[{k}])')} FROM (
    SELECT it, c{n}.doc_id, a, w, lam, count / list_dot_product(lam, w) AS r FROM c{n} JOIN (
      SELECT it, doc_id, list_transform(gamma, lambda x: exp({psi})) AS w FROM g{n} WHERE it < {INNER}) USING (doc_id), {alpha})
  GROUP BY it, doc_id),
s{n} AS MATERIALIZED (SELECT term_id, {_each('sum(r * w[{k}] * lam[{k}])')} AS sums FROM (
  SELECT term_id, lam, w, count / list_dot_product(lam, w) AS r FROM c{n} JOIN (
    SELECT doc_id, list_transform(gamma, lambda x: exp({psi})) AS w FROM g{n} WHERE it = {INNER - 1}) USING (doc_id))
  GROUP BY term_id),
u{n} AS MATERIALIZED (SELECT {_each('sum(p[{k}] - ' + digamma_sql('t') + ')')} AS suff, count(*) AS d FROM (
  SELECT list_transform(gamma, lambda x: {psi}) AS p, list_sum(gamma) AS t FROM g{n} WHERE it = {INNER})),
m{n} AS MATERIALIZED (SELECT term_id, {_each(f'({ETA} + sums[{{k}}]) / z[{{k}}]')} AS lam FROM s{n},
  (SELECT {_each(f'sum({ETA} + sums[{{k}}])')} AS z FROM s{n})),"""


def _newton(alpha: str, n: int) -> str:
    """The Dirichlet parameter after the Newton steps: tables n and a with suffix ``n``."""
    total = "list_sum(a)::DOUBLE"
    steps = f"""
  SELECT it + 1 AS it, a AS old, list_transform(list_zip(a, h), lambda p: p[1] - p[2] * coalesce(factor, 0)) AS a, d, suff FROM (
    SELECT *, list_min(list_transform(list_filter(range(12), lambda e: len(list_filter(list_zip(a, h), lambda p: p[2] * 0.8 ** e > p[1])) = 0),
                                      lambda e: e)) AS e, 0.8 ** e AS factor FROM (
      SELECT *, list_transform(list_zip(g, q), lambda p: (p[1] - b) * p[2]) AS h FROM (
        SELECT *, list_sum(list_transform(list_zip(g, q), lambda p: p[1] * p[2])) / (1 / (d * {trigamma_sql('t')}) + list_sum(q)) AS b FROM (
          SELECT *, list_transform(list_zip(a, suff), lambda p: d * ({digamma_sql('t')} - {digamma_sql('p[1]')}) + p[2]) AS g,
                 list_transform(a, lambda x: -1 / (d * {trigamma_sql('x')})) AS q FROM (
            SELECT *, {total} AS t FROM n{n} WHERE it <= 1000 AND
              (it = 0 OR len(list_filter(list_zip(a, old), lambda p: abs((p[1] - p[2]) / p[2]) > 1e-6)) > 0))))))"""
    return f"""
n{n}(it, old, a, d, suff) AS (
  SELECT 0, a, a, d::DOUBLE, suff FROM {alpha}, u{n}
  UNION ALL {steps}),
a{n} AS (SELECT a FROM n{n} ORDER BY it DESC LIMIT 1),"""


_START = f"""WITH RECURSIVE dt AS MATERIALIZED ({DOC_TERMS}),
v AS (SELECT max(term_id) + 1 AS size FROM dt),
a0 AS (SELECT list_transform(range({K}), lambda x: {ALPHA0}::DOUBLE) AS a),
m0 AS MATERIALIZED (SELECT term_id, list(u ORDER BY k) AS lam FROM (
  SELECT term_id, k, {_uniform(0)} / ({_uniform(1)} + size) AS u FROM (SELECT DISTINCT term_id FROM dt), range({K}) AS r(k), v)
  GROUP BY term_id),"""
_ONE = _em(_START, "m0", "a0", 1)
_TOPICS = "unnest(range({k}))::INT AS k".format(k=K)

TOPIC_STATS = _ONE.rstrip(",") + f"""
SELECT {_TOPICS}, term_id, round(unnest(sums), 6) AS value FROM s1
UNION ALL SELECT {_TOPICS}, -1, round(unnest(suff), 6) FROM u1"""
NORMALIZE_TOPICS = _ONE.rstrip(",") + f"""
SELECT term_id, {_TOPICS}, round(unnest(lam), 9) AS value FROM m1"""
ALPHA_NEWTON = _ONE + _newton("a0", 1).rstrip(",") + f"""
SELECT {_TOPICS}, round(unnest(a), 9) AS alpha FROM a1"""
LDA_EM = _em(_ONE + _newton("a0", 1), "m1", "a1", 2).rstrip(",") + f"""
SELECT k, (rn - 1)::INT AS rank, term, round(value, 9) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, term_id) AS rn
  FROM (SELECT term_id, {_TOPICS}, unnest(lam) AS value FROM m2))
JOIN ({VOCAB}) USING (term_id) WHERE rn <= 10"""
