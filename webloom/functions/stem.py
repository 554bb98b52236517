"""Porter stemming (classic algorithm, with the two well-known departures
``bli -> ble`` and ``logi -> log``) as built-in array expressions.

``stem_expression`` maps an ``array<string>`` column of lower-case tokens to
their stems with a chain of ``transform`` passes: one pass per rule step,
each step a ``CASE`` over suffixes that only decides "keep n letters, append
a fixed string". The consonant/vowel shape of a word is computed once with
regexes and carried along (a suffix change updates it in place), so nothing
leaves the JVM. It suits a table of distinct terms (``stem``).

A corpus repeats its terms, so ``stem_tokens`` sends arrays of tokens to Python
in Arrow batches: a batch's distinct terms are stemmed once each (``porter``, which a worker
remembers for its frequent terms) and put back by index. A document's tokens stay
in place, without a shuffle or a join against a stem table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix rules, in the order they are tried.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
         "ate", "iti", "ous", "ive", "ize")


def _shape_fold(w: Column) -> Column:
    """'c'/'v' per letter by a left fold (exact for any word)."""
    return F.aggregate(
        F.split(w, ""), F.lit(""),
        lambda acc, ch: F.concat(acc, F.when(ch.isin("a", "e", "i", "o", "u"), F.lit("v"))
                                 .when(ch == "y", F.when((acc == "") | acc.endswith("v"), F.lit("c")).otherwise("v"))
                                 .otherwise(F.lit("c"))))


def _shape(w: Column) -> Column:
    """'c'/'v' per letter: a e i o u are vowels, y is a vowel after a consonant.

    Regex passes; words with a run of y's (whose classes alternate) use the fold.
    """
    s = F.regexp_replace(w, "[^aeiouy]", "C")
    s = F.regexp_replace(s, "[aeiou]", "V")
    s = F.regexp_replace(s, "^y|(?<=V)y", "C")
    s = F.translate(F.regexp_replace(s, "y", "V"), "CV", "cv")
    return F.when(w.contains("yy"), _shape_fold(w)).otherwise(s)


def _static_shape(rep: str) -> str:
    return "".join("v" if ch in "aeiou" else "c" for ch in rep)


def _m(shape: Column, n: Column) -> Column:
    """Measure of the first n letters: number of vowel->consonant transitions."""
    x = F.substring(shape, 1, n)
    return (F.length(x) - F.length(F.replace(x, F.lit("vc"), F.lit("")))) / 2


def _has_vowel(shape: Column, n: Column) -> Column:
    return F.instr(F.substring(shape, 1, n), "v") > 0


def _cvc(w: Column, shape: Column, i: Column) -> Column:
    """Letters i-2, i-1, i (0-based) are consonant-vowel-consonant, the last not w, x or y."""
    return ((i >= 2) & (F.substring(shape, i - 1, 3) == "cvc")
            & ~F.substring(w, i + 1, 1).isin("w", "x", "y"))


def _double_c(w: Column, shape: Column, n: Column) -> Column:
    """The first n letters end in a doubled consonant."""
    return ((n >= 2) & (F.substring(w, n, 1) == F.substring(w, n - 1, 1)) & (F.substring(shape, n, 1) == "c"))


# A step decides how many letters to keep and which fixed string to append.
def _d(keep: Column, add: str = "") -> Column:
    return F.struct(keep.alias("n"), F.lit(add).alias("a"), F.lit(_static_shape(add)).alias("sa"))


def _apply(x: Column, d: Column) -> Column:
    return F.struct(F.concat(F.substring(x["w"], 1, d["n"]), d["a"]).alias("w"),
                    F.concat(F.substring(x["s"], 1, d["n"]), d["sa"]).alias("s"))


def _step1a(x: Column) -> Column:
    w = x["w"]
    n = F.length(w)
    return (F.when(w.endswith("sses"), _d(n - 2))
            .when(w.endswith("ies"), _d(n - 3, "i"))
            .when(w.endswith("s") & ~w.endswith("ss"), _d(n - 1))
            .otherwise(_d(n)))


def _step1b(x: Column) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)

    def after(k: int) -> Column:
        ln = n - k
        stem = F.substring(w, 1, ln)
        return (F.when(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"), _d(ln, "e"))
                .when(_double_c(w, s, ln), F.when(F.substring(w, ln, 1).isin("l", "s", "z"), _d(ln)).otherwise(_d(ln - 1)))
                .when((_m(s, ln) == 1) & _cvc(w, s, ln - 1), _d(ln, "e"))
                .otherwise(_d(ln)))

    return (F.when(w.endswith("eed"), F.when(_m(s, n - 3) > 0, _d(n - 1)).otherwise(_d(n)))
            .when(w.endswith("ed"), F.when(_has_vowel(s, n - 2), after(2)).otherwise(_d(n)))
            .when(w.endswith("ing"), F.when(_has_vowel(s, n - 3), after(3)).otherwise(_d(n)))
            .otherwise(_d(n)))


def _step1c(x: Column) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)
    return F.when(w.endswith("y") & _has_vowel(s, n - 1), _d(n - 1, "i")).otherwise(_d(n))


def _replace_rules(x: Column, rules, min_m: int) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)
    out = None
    for suf, rep in rules:
        k = len(suf)
        hit = F.when(_m(s, n - k) > min_m, _d(n - k, rep)).otherwise(_d(n))
        out = F.when(w.endswith(suf), hit) if out is None else out.when(w.endswith(suf), hit)
    return out.otherwise(_d(n))


def _step4(x: Column) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)
    out = None
    for suf in STEP4:
        k = len(suf)
        ok = _m(s, n - k) > 1
        if suf == "ion":
            ok = F.substring(w, -4, 1).isin("s", "t") & (n >= 4) & ok
        hit = F.when(ok, _d(n - k)).otherwise(_d(n))
        out = F.when(w.endswith(suf), hit) if out is None else out.when(w.endswith(suf), hit)
    return out.otherwise(_d(n))


def _step5a(x: Column) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)
    m = _m(s, n)
    drop = w.endswith("e") & ((m > 1) | ((m == 1) & ~_cvc(w, s, n - 2)))
    return F.when(drop, _d(n - 1)).otherwise(_d(n))


def _step5b(x: Column) -> Column:
    w, s = x["w"], x["s"]
    n = F.length(w)
    return F.when(w.endswith("l") & _double_c(w, s, n) & (_m(s, n) > 1), _d(n - 1)).otherwise(_d(n))


STEPS = (_step1a, _step1b, _step1c, lambda x: _replace_rules(x, STEP2, 0), lambda x: _replace_rules(x, STEP3, 0),
         _step4, _step5a, _step5b)
# Endings a step can act on: words without one skip the step untouched.
STEP_ENDINGS = (("s",), ("ed", "ing"), ("y",), tuple(s for s, _ in STEP2), tuple(s for s, _ in STEP3), STEP4,
                ("e",), ("ll",))


def _ends_any(w: Column, endings) -> Column:
    return _or([w.endswith(e) for e in endings])


def _or(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def stem_expression(tokens: Column) -> Column:
    """Porter stems of an array of lower-case tokens (words of 1-2 letters stay)."""
    def run(step, endings):
        return lambda x: F.when((F.length(x["w"]) <= 2) | ~_ends_any(x["w"], endings), x).otherwise(
            _apply(x, step(x)))

    a = F.transform(tokens, lambda t: F.struct(t.alias("w"), _shape(t).alias("s")))
    for step, endings in zip(STEPS, STEP_ENDINGS):
        a = F.transform(a, run(step, endings))
    return F.transform(a, lambda x: x["w"])


def stem(term: Column) -> Column:
    """Porter stem of one lower-case term."""
    return F.element_at(stem_expression(F.array(term)), 1)


# ------------------------------------------------------------------ the same rules for distinct terms in Arrow batches

def _classes(w: str) -> str:
    """'c'/'v' per letter."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _classes(w).count("vc")


def _short_end(w: str) -> bool:
    return _classes(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _classes(w)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            base = w[:-len(end)]
            if "v" not in _classes(base):
                return w
            if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _short_end(base) and not _doubled(base)):
                return base + "e"
            return base[:-1] if _doubled(base) and base[-1] not in "lsz" else base
    return w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and "v" in _classes(w[:-1]) else w


def _replaced(w: str, rules) -> str:
    for end, new in rules:
        if w.endswith(end):
            return w[:-len(end)] + new if _measure(w[:-len(end)]) else w
    return w


def _removed(w: str) -> str:
    for end in STEP4:
        if w.endswith(end):
            base = w[:-len(end)]
            return base if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))) else w
    return w


def _final_e(w: str) -> str:
    if not w.endswith("e"):
        return w
    m = _measure(w)
    return w[:-1] if m > 1 or (m == 1 and not _short_end(w[:-1])) else w


def _final_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


_WORD_STEPS = (_plural, _past, _final_y, lambda w: _replaced(w, STEP2), lambda w: _replaced(w, STEP3), _removed, _final_e, _final_l)


@functools.lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """Porter stem of one lower-case word."""
    for step in _WORD_STEPS:
        if len(word) > 2:
            word = step(word)
    return word


def _stem_arrays(tokens: pa.Array) -> pa.Array:
    index = tokens.flatten().dictionary_encode()
    stems = pa.array([w if w is None else porter(w) for w in index.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), stems.take(index.indices), mask=pc.is_null(tokens))


def stem_tokens(tokens: Column) -> Column:
    """Porter stems of an array of lower-case tokens (words of 1-2 letters stay)."""
    return F.arrow_udf(_stem_arrays, ArrayType(StringType()))(tokens)
