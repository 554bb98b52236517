"""Text cleaning (T1-T10): URLs and numbers out, analyzer (tokens, possessive,
lower case, stop words, Porter stems), ASCII folding, symbol stripping.

All steps are column expressions over the text value (arrays inside the
row, no explode), so cleaning a corpus is a map-only stage.
"""

from __future__ import annotations

import functools
import os
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.fold import ascii_fold
from webloom.functions.stem import stem_tokens

# Patterns of the cleaner.
URL_RE = r"(?i)\b(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]"
# (a class of single Latin-1 characters is one table look-up for Java; a range, or another character, is a call each)
_LETTERS = string.ascii_letters
NUMBER_RE = r"[^" + _LETTERS + r"][0-9]+[^" + _LETTERS + "]"
SYMBOL_RE = r"[^a-zA-Z0-9 ]+"

# Word-break rules: letters, marks, digits and underscore join; ' . : ’ ‘ ·
# join two letters; . , ; ' ’ ‘ join two digits; Han and Hiragana characters
# are tokens of their own. Punctuation that joins nothing is blanked first, so
# that a token is one run of a character class, whatever its length.
_IDEO = r"\p{IsHan}\p{IsHiragana}"
_JOINS = "'.:’‘·,;"
# (the look-aheads at a start and the ASCII class only spare most characters the slower classes)
_ASCII = _LETTERS + string.digits + "_"
LOOSE_PUNCTUATION_RE = (r"(?![ " + _ASCII + r"])(?!(?<=[\p{L}\p{M}])['.:’‘·]\p{L}|(?<=\p{Nd})[.,;'’‘]\p{Nd})[" + _JOINS + "]")
ANALYZER_TOKEN_RE = (r"(?! )(?:(?:[" + _ASCII + r"]++|(?! )[\p{L}\p{M}\p{Nd}" + _JOINS + r"&&[^" + _ASCII + _IDEO + r"]]++)++"
                     r"|[" + _IDEO + r"])")
POSSESSIVE_RE = r"['’＇][sS]$"

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")


@functools.lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """Union of the four stop-word lists (T4), as stored, case-sensitive."""
    words: set[str] = set()
    with open(os.path.join(RESOURCES, "stop_words.txt"), encoding="utf-8") as fh:
        for line in fh:
            line = line.rstrip("\n")
            if line and not line.startswith("#"):
                words.update(line.split(","))
    return tuple(sorted(words))


def remove_urls(text: Column) -> Column:
    """T1. Texts without "://" are only scanned for it."""
    return F.when(text.contains("://"), F.regexp_replace(text, URL_RE, "")).otherwise(text)


def remove_numbers(text: Column) -> Column:
    """A number together with one non-letter on each side."""
    return F.regexp_replace(text, NUMBER_RE, "")


def all_tokens(text: Column) -> Column:
    """Runs of word characters, those without a letter or digit included."""
    return F.regexp_extract_all(F.regexp_replace(text, LOOSE_PUNCTUATION_RE, " "), F.lit(ANALYZER_TOKEN_RE), 0)


def is_term(token: Column) -> Column:
    return token.rlike(r"[\p{L}\p{Nd}]")


def lowered(token: Column) -> Column:
    """Possessive 's removed, lower case."""
    return F.lower(F.regexp_replace(token, POSSESSIVE_RE, ""))


def analyzer_tokens(text: Column) -> Column:
    """Word tokens (T3 first stage)."""
    return F.filter(all_tokens(text), is_term)


def drop_stop_words(tokens: Column, words: tuple[str, ...] | None = None) -> Column:
    """T4: tokens not in the stop list (exact, after lower-casing)."""
    sw = list(words if words is not None else stop_words())
    return F.filter(tokens, lambda t: ~t.isin(*sw))


def analyze(text: Column, stem: bool = True) -> Column:
    """Tokens -> possessive 's removed -> lower case -> stop words out -> stems."""
    toks = F.transform(analyzer_tokens(text), lowered)
    toks = drop_stop_words(toks)
    return stem_tokens(toks) if stem else toks


def strip_symbols(text: Column) -> Column:
    """Keep letters, digits and spaces; collapse whitespace; trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, SYMBOL_RE, ""), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """T1, T2, T3, T6, T7 in that order."""
    return stem_and_fold(analyze(remove_numbers(remove_urls(text)), stem=False))


def stem_and_fold(tokens: Column) -> Column:
    """The rest of T8 for analyzer tokens without stems: stems, ASCII folding, symbols out."""
    return strip_symbols(ascii_fold(F.array_join(stem_tokens(tokens), " ")))


def append_newline(text: Column) -> Column:
    """Stored form of a cleaned text."""
    return F.concat(text, F.lit("\n"))


def strip_stored_newline(text: Column) -> Column:
    """T10 on import: the stored trailing newline removed before splitting."""
    return F.regexp_replace(text, r"\n$", "")


# ------------------------------------------------------------------ corpus-scale cleaning (DataFrame job)

def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T8 for a corpus: (doc_id, text), in one pass without an exchange. A null text cleans to an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
