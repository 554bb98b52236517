"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Column expressions only. A pattern's matches and the gaps between them are
taken from the text in one pass each; a span's place is the running sum of
both lengths, in code points. Context is cut from pieces of the text, so the
work is in proportion to the text and its matches. Possessive quantifiers and the look-behinds
keep every pattern linear in the text and off the Java stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import let, sums_before

#: Code points on either side of a span in which context words count.
CONTEXT_CHARS = 40
#: Code points of the pieces that context is cut from.
PIECE_CHARS = 1024
#: Bits a character from which an assigned value is taken for a secret; words and plain numbers have fewer.
MIN_ENTROPY = 3.0
#: What a context word adds to a span's score.
CONTEXT_SCORE = 0.4
#: Spans of the added kinds need this score; those of the base kinds always stay.
MIN_SCORE = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _always(m: Column) -> Column:
    return F.lit(True)


def ip_parts(m: Column) -> Column:
    """Every dotted part is at most 255, leading zeros aside."""
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0++", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
    return F.forall(F.split(m, "\\."), small)


def luhn(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    ds = F.regexp_extract_all(F.reverse(_digits(m)), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + d)
    return F.when(F.length(_digits(m)).between(14, 19), total % 10 == 0).otherwise(False)


def ten_to_fifteen(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def mod97(m: Column) -> Column:
    """The account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    chars = F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0))
    rest = F.aggregate(chars, F.lit(0), lambda s, c: F.when(
        c >= "A", (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97))
    return F.length(bare).between(15, 34) & (rest == 1)


def random_value(m: Column) -> Column:
    """The assigned value's characters have the entropy of a random key."""
    value = F.regexp_extract(m, "[A-Za-z0-9+/_-]{16,}={0,2}$", 0)

    def entropy(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return let(F.split(value, ""), entropy) >= MIN_ENTROPY


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this cheap test has no match of the pattern.
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


#: The patterns of the base kinds, in the order in which spans of equal start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         _always, 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", ip_parts, 0.6, "ip|address|server|host|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", luhn, 0.7, "card|visa|master|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", ten_to_fifteen, 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])",
         "[A-Z]{2}[0-9]{2}", mod97, 0.8, "iban|account|bank", base=False),
    Kind("ssn", r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])", "[0-9]-[0-9]{2}-", _always, 0.3,
         "ssn|social security", base=False),
    Kind("secret", "(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
         "[\"']?[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?[A-Za-z0-9+/_-]{16,}={0,2}", "[=:]", random_value, 0.6, "key|login|auth", base=False),
)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,text:string>>")
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("gap")))

    def placed(pairs: Column) -> Column:
        """The text after the last match is a pair without one."""
        before = sums_before(F.transform(pairs, lambda p: p.gap + F.coalesce(F.length(p.m), F.lit(0))))

        def span(p: Column, at: Column) -> Column:
            begin = (at + p.gap).cast("int")
            return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(p.m)).alias("end"),
                            p.m.alias("text"))

        return F.filter(F.zip_with(pairs, before, span), lambda s: F.when(s.text.isNull(), False).otherwise(kind.valid(s.text)))

    return F.when(text.rlike(kind.needs), let(pairs, placed)).otherwise(none)


def findings(text: Column, kinds: tuple[Kind, ...] = KINDS, min_score: float = MIN_SCORE) -> Column:
    """Array of ``(start, rank, end, text, kind, score)`` of the personal data in a text, by start, then kind.

    Matches of each kind are leftmost and do not overlap one another; those
    that fail their check are dropped without another try. A span's score is
    its kind's, plus ``CONTEXT_SCORE`` (at most 1 in all) if a context word of
    the kind stands near it. Kinds beyond the base need ``min_score``. A null
    text is empty and has none.
    """
    whole = F.coalesce(text, F.lit(""))
    all_spans = F.array_sort(F.concat(*(_spans(whole, k, i) for i, k in enumerate(kinds))))

    def pieces(spans: Column) -> Column:
        cut = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
        return F.when(F.size(spans) > 0, cut).otherwise(F.array().cast("array<string>"))

    def around(parts: Column, at: Column) -> tuple[Column, Column]:
        """The piece that holds a place with the one before it and the one after it, and the place therein."""
        i = F.floor(at / PIECE_CHARS).cast("int")
        near = F.array_join(F.slice(parts, F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2)), "")
        return near, at - F.greatest(i - 1, F.lit(0)) * PIECE_CHARS

    def scored(parts: Column, s: Column) -> Column:
        ahead, start = around(parts, s.start)
        behind, end = around(parts, s.end)
        near = F.lower(F.concat(
            F.substring(ahead, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))),
            F.lit(" "), F.substring(behind, end + 1, F.lit(CONTEXT_CHARS))))

        def pick(of: Callable[[Kind], Column]) -> Column:
            return F.element_at(F.array(*(of(k) for k in kinds)), s.rank + 1)

        score = F.coalesce(*(F.when(s.rank == i, F.least(F.lit(1.0), F.lit(k.score) + F.when(
            near.rlike(k.context), CONTEXT_SCORE).otherwise(0.0))) for i, k in enumerate(kinds)))
        return F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"), s.text.alias("text"),
                        pick(lambda k: F.lit(k.name)).alias("kind"), score.alias("score"),
                        pick(lambda k: F.lit(k.base)).alias("base"))

    return let(all_spans, lambda spans: let(pieces(spans), lambda parts: F.filter(
        F.transform(spans, lambda s: scored(parts, s)), lambda s: s.base | (s.score >= min_score))))


def find_pii(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with the array column ``findings``. One row for each row; null texts and repeats included."""
    return docs.withColumn("findings", findings(F.col("text"), KINDS, min_score))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans as ``kind:start:end``, and counts of secrets and of all."""
    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("findings", lambda s: s.rank == rank)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    return found.select("doc_id", *counts, F.sha2(line(F.filter("findings", lambda s: s.base)), 256).alias("base_sha256"),
                        line(F.col("findings")).alias("spans"),
                        F.size(F.filter("findings", lambda s: s.kind == "secret")).cast("long").alias("n_secret"),
                        F.size("findings").cast("long").alias("n_spans"))
