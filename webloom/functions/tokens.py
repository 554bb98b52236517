"""Column functions for splitting text: lines, space tokens, block word counting.

All of them are built-in Spark expressions (regexp, split, higher-order
``aggregate``), so they run inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the block-extraction rules we reproduce):
#   a token is a word when it holds a letter or a number character;
#   tokens stay joined across these punctuation characters: " ' . , ! @ - : ; $ ? ( ) /
#   lines wrap after 80 characters.
WORD_CHAR = r"[\p{L}\p{N}]"
JOINING_PUNCT = "\"'.,!@\\-:;$?()/"
MAX_LINE_LENGTH = 80

# Characters Java's Character.isWhitespace accepts (no-break spaces excluded).
JAVA_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"

# Private-use characters standing for "anchor starts" / "anchor ends" inside a
# block's token string (never produced by decoding text).
ANCHOR_START = "\ue00a"
ANCHOR_END = "\ue00b"
# Soft space: a whitespace that collapses with its neighbours at text-run borders.
SOFT_SPACE = "\ue000"

_WORD = r"\p{L}\p{Nd}_"
_OTHER = "[^" + _WORD + " " + JOINING_PUNCT + "]"
_SPLIT_AT_OTHER = ("(?<=[" + _WORD + "])(?=" + _OTHER + ")|(?<=" + _OTHER + ")(?=[" + _WORD + "])")


def text_lines(text: Column) -> Column:
    """Array of lines of a text value, split like a line reader does
    (``\\n``, ``\\r`` or ``\\r\\n``; a final terminator opens no extra line;
    an empty value has no lines)."""
    body = F.regexp_replace(text, r"(\r\n|\r|\n)$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))


def space_tokens(line: Column) -> Column:
    """``line.split(" ")`` with Java semantics: inner and leading empty words
    stay, trailing ones go; an all-space line has no words and an empty line
    has one empty word."""
    stripped = F.regexp_replace(line, " +$", "")
    return (F.when(line == "", F.array(F.lit("")))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, " ")))


def block_tokens(token_text: Column) -> Column:
    """Tokens of a block's token string.

    Word boundaries split tokens unless the non-word side is one of the
    joining punctuation characters; spaces always split.
    """
    spaced = F.regexp_replace(token_text, _SPLIT_AT_OTHER, " ")
    return F.split(F.trim(F.regexp_replace(spaced, " +", " ")), " ")


def is_word(token: Column) -> Column:
    return token.rlike(WORD_CHAR)


def block_counts(tokens: Column, in_anchor_at_start: Column) -> Column:
    """Fold over a block's tokens: words, linked words, wrapped lines.

    Returns struct(num_tokens, num_words, num_anchor_words, num_words_wrapped,
    num_wrapped_lines); wrapping is greedy at 80 characters, the words of the
    last unfinished line are not counted as wrapped.
    """
    init = F.struct(
        in_anchor_at_start.cast("boolean").alias("a"),
        F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(0).alias("l"),
        F.lit(-1).alias("len"), F.lit(0).alias("wl"), F.lit(0).alias("cw"))

    # a fold evaluates its expressions anew wherever they stand, so each token is looked at once before it:
    # -1 and -2 for the anchor marks, the length of a word, 0 otherwise
    codes = F.transform(tokens, lambda t: F.when(t == F.lit(ANCHOR_START), -1).when(t == F.lit(ANCHOR_END), -2)
                        .when(is_word(t), F.length(t)).otherwise(0))

    def step(acc, tl):
        start, end, word = tl == -1, tl == -2, tl > 0
        grown = acc["len"] + tl + 1
        wrap = word & (grown > MAX_LINE_LENGTH)
        return F.struct(
            F.when(start, F.lit(True)).when(end, F.lit(False)).otherwise(acc["a"]).alias("a"),
            (acc["n"] + F.when(start | end, 0).otherwise(1)).alias("n"),
            (acc["w"] + F.when(word, 1).otherwise(0)).alias("w"),
            (acc["l"] + F.when(word & acc["a"], 1).otherwise(0)).alias("l"),
            F.when(word, F.when(wrap, tl).otherwise(grown)).otherwise(acc["len"]).alias("len"),
            (acc["wl"] + F.when(wrap, 1).otherwise(0)).alias("wl"),
            F.when(word, F.when(wrap, 1).otherwise(acc["cw"] + 1)).otherwise(acc["cw"]).alias("cw"))

    def finish(acc):
        words_wrapped = F.when(acc["wl"] == 0, acc["w"]).otherwise(acc["w"] - acc["cw"])
        return F.struct(
            acc["n"].alias("num_tokens"), acc["w"].alias("num_words"), acc["l"].alias("num_anchor_words"),
            F.when(words_wrapped == 0, acc["w"]).otherwise(words_wrapped).alias("num_words_wrapped"),
            F.when((acc["wl"] == 0) | (words_wrapped == 0), 1).otherwise(acc["wl"]).alias("num_wrapped_lines"))

    return F.aggregate(codes, init, step, finish)


def count_words(text: Column) -> Column:
    """Number of word tokens of a text."""
    return F.size(F.filter(block_tokens(text), lambda t: is_word(t)))


def java_trim(s: Column) -> Column:
    """``String.trim()``: strips every character up to U+0020 at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def spaces_only(text: Column) -> Column:
    """Every whitespace character a space; printable ASCII texts, the most, are only scanned."""
    return F.when(text.rlike("[^ -~]"), F.regexp_replace(text, JAVA_WHITESPACE, " ")).otherwise(text)


def trim_spaces(text: Column) -> Column:
    """Spaces at both ends removed; before a final next-line character, too, where the pattern's ``$`` also matches."""
    return F.when(text.contains("\u0085"), F.regexp_replace(text, "^ +| +$", "")).otherwise(F.trim(text))
