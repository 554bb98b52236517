"""Word counts and top-k.

Plan shape: lines and words are produced by ``explode`` next to the scan (no
shuffle); the count is a partial + final hash aggregate, so a hot word costs
one row per map task in the shuffle; top-k is ``TakeOrderedAndProject``
(a per-partition heap merged once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.tokens import space_tokens, text_lines


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text line: (doc_id, line_no, line)."""
    return docs.select(id_col, F.posexplode(text_lines(F.col(text_col))).alias("line_no", "line"))


def words(line_df: DataFrame, line_col: str = "line", keep: tuple = ("doc_id", "line_no")) -> DataFrame:
    """``split(" ")`` per line: (…keep, word_no, word)."""
    return line_df.select(*keep, F.posexplode(space_tokens(F.col(line_col))).alias("word_no", "word"))


def nonempty(word_df: DataFrame, col: str = "word") -> DataFrame:
    return word_df.where(F.col(col) != "")


def lowercase(word_df: DataFrame, col: str = "word") -> DataFrame:
    return word_df.withColumn(col, F.lower(F.col(col)))


def word_count(word_df: DataFrame, col: str = "word") -> DataFrame:
    """(word, cnt): occurrences per word."""
    return word_df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def top_k(counts: DataFrame, k: int = 100, col: str = "word") -> DataFrame:
    """The k most frequent words; ties broken by the word for a stable answer."""
    return counts.orderBy(F.col("cnt").desc(), F.col(col).asc()).limit(k)


def top_k_threshold(word_df: DataFrame, threshold: int, k: int = 100, max_len: int = 30,
                    col: str = "word") -> DataFrame:
    """Lowercased counts, words shorter than ``max_len`` seen more than
    ``threshold`` times, the k most frequent. The length test runs before the
    aggregate (it only depends on the key)."""
    lowered = word_df.select(F.lower(F.col(col)).alias(col)).where(F.length(col) < max_len)
    counts = word_count(lowered, col).where(F.col("cnt") > threshold)
    return top_k(counts, k, col)


def top_words_of_lines(docs: DataFrame, k: int = 100) -> DataFrame:
    """The classic job: text lines -> words -> counts -> top k."""
    return top_k(word_count(words(lines(docs))), k)
