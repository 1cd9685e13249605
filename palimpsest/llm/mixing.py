"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import digest52, read, unit

SEED = "mix"
#: Up to so many sources (a name and a short array each) their rates are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 2_000
#: A larger mean is dealt as the sum of equal parts no larger than this, each drawn for itself.
LARGEST_MEAN = 200.0


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def rates(df: DataFrame, target: dict[str, float] | None = None, exponent: float = 0.5, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: its characters, target weight and mean repetition rate (weight * budget * all characters / its characters).

    Weights are `target` (sources that it lacks get 0), or each source's characters to the power `exponent`. A source
    without any characters has rate 0: no repetition of its rows can reach a weight. A null source is a source.
    """
    sized = df.groupBy(_source_key(source_col).alias("mix_source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("chars"))
    if target is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(exponent))
    else:
        raw = F.lit(0.0)
        for name, w in target.items():
            raw = F.when(F.col("mix_source") == F.lit(f"s{name}" if name is not None else "null"), F.lit(float(w))).otherwise(raw)
    raw = F.when(F.col("chars") > 0, raw).otherwise(0.0)
    totals = sized.agg(F.sum("chars").alias("all_chars"), F.sum(raw).alias("all_raw")).first()
    all_chars, all_raw = totals["all_chars"] or 0, totals["all_raw"] or 0.0
    weight = raw / F.lit(all_raw or 1.0)
    rate = F.when(F.col("chars") > 0, weight * F.lit(budget * all_chars) / F.col("chars")).otherwise(0.0)
    return sized.select("mix_source", "chars", weight.alias("weight"), rate.alias("rate"))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as a double tells them from 1. Mean up to LARGEST_MEAN."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    start = F.struct((-mean).alias("log"), F.array(F.exp(-mean)).alias("cdf"))

    def longer(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(mean / k)
        return F.struct(log.alias("log"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log))).alias("cdf"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), last), start, longer, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def mix(df: DataFrame, target: dict[str, float] | None = None, exponent: float = 0.5, budget: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """df's rows, each as often as a hash-seeded Poisson draw with its source's rate says, in one global random order.

    Adds mix_copy (1, 2, ...) and mix_key, the number by which the result is sorted over all partitions. Keys are uniform, so
    that partitions' bounds are known beforehand and no rows are sampled for them. The draw depends on id, source and seed only, so rows that repeat are drawn alike and a lost task draws the same again.
    Rows of a source of rate 0 go; an empty table stays empty; columns of df that have the added names are replaced.
    """
    df = df.drop("mix_copy", "mix_key", "mix_source", "mix_cdf", "mix_parts")
    rate = rates(df, target, exponent, budget, source_col, text_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST_MEAN))).cast("int")
    table = rate.filter("rate > 0").select("mix_source", parts.alias("mix_parts"), poisson_cdf(F.col("rate") / parts).alias("mix_cdf"))
    if table.count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col("mix_cdf"), lambda c: c < unit(F.lit(seed), F.col(id_col), F.col("mix_source"), i))),
    )
    drawn = df.withColumn("mix_source", _source_key(source_col)).join(table, "mix_source")
    copies = drawn.withColumn("mix_copies", draw).filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    keyed = copies.withColumn("mix_key", digest52(F.lit(seed), F.col(id_col), F.col("mix_copy"), F.lit("order")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("mix_key") / F.lit(float(1 << 52)) * n).cast("int")
    placed = keyed.drop("mix_source", "mix_parts", "mix_cdf", "mix_copies").repartitionById(n, F.least(part, F.lit(n - 1)))
    return placed.sortWithinPartitions("mix_key", id_col, "mix_copy")


def op7_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def _unit(expr: str) -> str:
    return f"(CAST('0x' || substr(md5({expr}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def sql(documents: str = "documents") -> str:
    """DuckDB's SQL for mix() of the named relation with its default parameters."""
    key = "coalesce('s' || source, 'null')"
    doc = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    return f"""
WITH sized AS (SELECT {key} AS mix_source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM {documents} GROUP BY 1),
rated AS (SELECT mix_source, sqrt(chars) / (SELECT sum(sqrt(chars)) FROM sized) * (SELECT sum(chars) FROM sized) / chars AS rate FROM sized WHERE chars > 0),
steps AS (SELECT mix_source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rated),
cdf AS (SELECT mix_source, list(c ORDER BY k) AS cdf FROM (
  SELECT mix_source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY mix_source ORDER BY k) AS c FROM steps) GROUP BY 1),
drawn AS (SELECT d.*, len(list_filter(cdf, lambda c: c < {_unit(f"'mix:' || {doc} || ':' || {key} || ':1'")})) AS mix_copies
  FROM {documents} d JOIN cdf ON {key} = mix_source),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, mix_copies + 1)) AS INTEGER) AS mix_copy FROM drawn)
SELECT *, CAST('0x' || substr(md5('mix:' || {doc} || ':' || mix_copy || ':order'), 1, 13) AS BIGINT) AS mix_key FROM copies
"""


SQL = sql()
