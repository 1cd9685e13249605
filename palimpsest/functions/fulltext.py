"""Full-text search: words, an inverted index, and matching with a relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = r"[^\p{L}\p{N}_']+"


def words(*columns: str) -> Column:
    """Lower-case words of all columns; nulls have none."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), _BREAK), lambda w: w != "")


def inverted_index(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(word, key, n): how often each row has each word."""
    return df.select(key, F.explode(words(*columns)).alias("word")).groupBy("word", key).agg(F.count(F.lit(1)).alias("n"))


def match_any(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Rows with any of the query's words, most different ones first known by `matched`; one pass, no index, no shuffle."""
    wanted = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), _BREAK), lambda w: w != ""))
    matched = F.size(F.array_intersect(words(*columns), wanted))
    return df.withColumn("matched", matched).filter("matched > 0")


def relevance(index: DataFrame, key: str, n_rows: int, query: str) -> DataFrame:
    """(key, relevance) from an index: squared inverse document frequency times term frequency, summed over the words."""
    wanted = [w for w in dict.fromkeys(query.lower().split()) if w]
    hits = index.filter(F.col("word").isin(wanted))
    frequency = hits.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    idf = F.log10(F.lit(float(n_rows)) / F.col("docs"))
    return hits.join(F.broadcast(frequency), "word").groupBy(key).agg(F.sum(F.col("n") * idf * idf).alias("relevance"))
