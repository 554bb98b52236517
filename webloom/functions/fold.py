"""Compatibility decomposition to ASCII (T6) with built-in expressions.

The tables are generated from the Unicode database of Python's standard
library: for every code point, the ASCII characters of its NFKD
decomposition. One-character results become a ``translate`` table (a hash
lookup per character); the few multi-character results go through a small
map, touched only by values that contain such a character.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


MULTI_MARK = "\ue031"


@functools.lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    src, dst, multi = [], [], {}
    for cp in range(0x80, min(sys.maxunicode, 0x2FFFF) + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        d = unicodedata.normalize("NFKD", ch)
        if d == ch:
            continue
        kept = "".join(c for c in d if c.isascii())
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        elif len(kept) > 1:
            multi[ch] = kept
    return "".join(src), "".join(dst), multi


def ascii_fold(value: Column) -> Column:
    """Characters replaced by the ASCII part of their NFKD form; other
    non-ASCII characters removed. The input is evaluated once (bound as a
    lambda variable), so an expensive input expression is not repeated."""
    return F.element_at(F.transform(F.array(value), _fold), 1)


def _fold(text: Column) -> Column:
    src, dst, multi = fold_tables()
    keys = "".join(multi)
    # cheap test first: a translate (hash lookup per character) to a marker
    has_multi = F.translate(text, keys, MULTI_MARK * len(keys)).contains(MULTI_MARK)
    mp = F.create_map(*[x for k, v in sorted(multi.items()) for x in (F.lit(k), F.lit(v))])
    expanded = F.when(has_multi, F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(mp[c], c)), "")
                      ).otherwise(text)
    folded = F.translate(expanded, src, dst)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")
