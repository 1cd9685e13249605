"""Quality rules: text statistics and a decision list learned from labels by sequential covering."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACES, WORD_BREAK, read, stored

#: Labelled rows that the list is learned from, as expected by a hash of their text: the fit's bound.
FIT_ROWS = 8_000
#: Cut points per statistic (quantiles of the sample), rules of a list, conditions of a rule.
CUTS, MAX_RULES, MAX_CONDITIONS = 15, 12, 4
#: A rule is kept if on the rows it was pruned with it is right this often, and meets so many at all.
LEAST_PRECISION, LEAST_MET = 0.75, 3

#: Code points of n_symbols.
SYMBOLS = "#*$%&|<>"
#: Statistics that conditions may use, each from the columns of `statistics`.
MEASURES = {
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}


def _only(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array holds twice or more, each word once, first windows included.

    The windows' hashes are sorted with their places; equal neighbours repeat. Without an equal pair, which a set of the
    hashes tells, nothing is sorted.
    """
    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def placed(h: Column) -> Column:
        ordered = F.sort_array(F.zip_with(h, F.sequence(F.lit(1), F.size(h)), lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return _let(ordered, lambda s: _let(
            F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["p"].alias("a"), b["p"].alias("b")))), lambda x: x.isNotNull()),
            lambda twice: covered(F.sort_array(F.array_distinct(F.concat(F.transform(twice, lambda x: x["a"]), F.transform(twice, lambda x: x["b"]))))),
        ))

    def counted(w: Column) -> Column:
        found = _let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(placed(h)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(found)

    return _let(words, counted)  # a filter that Spark moves below would else split the text again for each window


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_exclamations,
    n_digits (long), base_failed. A null text has no words. n_lines are lines with a word. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(F.col("t"), F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = df.select(F.col(id_col).alias("doc_id"), text.alias("t"), *more).select("doc_id", "t", words.alias("w"), lines.alias("l"), *more)
    counted = split.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.char_length(F.regexp_replace("t", WORD_BREAK, "")).cast("long").alias("word_chars"),
        _only(F.col("t"), SYMBOLS).alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"), _only(F.col("t"), "A-Z").alias("n_capitals"), _only(F.col("t"), "!").alias("n_exclamations"), _only(F.col("t"), "0-9").alias("n_digits"), *more,
    )
    return counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds; what meets it is of low quality. right of met are the figures it was kept by."""

    conditions: tuple[Condition, ...]
    right: int
    met: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"drop if {' and '.join(map(str, self.conditions))}  ({self.right} of {self.met})"


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one conditional expression over the columns of `statistics`: the first rule that is met drops the row."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


#: A cell of the labelled statistics: bins of the measures, then rows of low and of high quality, to grow and to prune with.
Cell = tuple[tuple[int, ...], tuple[int, int], tuple[int, int]]


def cover(cells: Sequence[Cell], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted cells: grow a rule by information gain, prune it on other rows, take out what it
    meets, go on. Bin b of a measure lies above its first b cuts."""
    names, rules, left = list(cuts), [], list(cells)

    def met(some: Sequence[Cell], conditions) -> list[Cell]:
        return [c for c in some if all((c[0][i] > b) == above for i, above, b in conditions)]

    def count(some: Sequence[Cell], part: int) -> tuple[int, int]:
        return sum(c[part][0] for c in some), sum(c[part][1] for c in some)

    while len(rules) < MAX_RULES:
        conditions: list[tuple[int, bool, int]] = []
        inside = left
        bad, good = count(inside, 1)
        while bad and good and len(conditions) < MAX_CONDITIONS:
            best = (0.0, None)
            for i, name in enumerate(names):
                below = [[0, 0] for _ in range(len(cuts[name]) + 1)]
                for c in inside:
                    below[c[0][i]][0] += c[1][0]
                    below[c[0][i]][1] += c[1][1]
                p = n = 0
                for b in range(len(cuts[name])):
                    p, n = p + below[b][0], n + below[b][1]
                    for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                        if x and (gain := x * (math.log2(x / (x + y)) - math.log2(bad / (bad + good)))) > best[0] + 1e-9:
                            best = (gain, (i, above, b))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = met(inside, conditions[-1:])
            bad, good = count(inside, 1)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in (count(met(left, conditions[:k]), 2) for k in range(1, len(conditions) + 1))]
        if not worth:
            break
        conditions = conditions[: worth.index(max(worth)) + 1]
        p, n = count(met(left, conditions), 2)
        if p + n < LEAST_MET or p < LEAST_PRECISION * (p + n):
            break
        rules.append(Rule(tuple(Condition(names[i], above, cuts[names[i]][b]) for i, above, b in conditions), p, p + n))
        gone = {id(c) for c in met(left, conditions)}
        left = [c for c in left if id(c) not in gone]
    return rules


def fit(labelled: DataFrame) -> list[Rule]:
    """A decision list from the rows of (text, quality 0 or 1, row); null texts and labels teach nothing.

    About FIT_ROWS of them, taken by a hash of the text and of row (an id), are measured, whole. The driver gets CUTS quantiles of each measure,
    then counts of the cells between them: at most one for each row of the sample. A list may be empty and then keeps all.
    """
    known = labelled.filter(F.col("text").isNotNull() & F.col("quality").isNotNull()).select("text", F.col("quality").cast("int").alias("quality"), F.xxhash64("text", *["row"] * ("row" in labelled.columns), F.lit("sample")).alias("h"))
    n = known.count()
    sample = known.filter(F.pmod("h", F.lit(1 << 20)) < F.lit(int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 20))))
    measured = statistics(sample, "h", more=["quality"]).filter("NOT base_failed").select("quality", F.pmod("doc_id", F.lit(3)).alias("part"), *[F.expr(e).alias(m) for m, e in MEASURES.items()])
    at = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    row = measured.agg(*[F.percentile_approx(m, at, F.lit(10_000)).alias(m) for m in MEASURES]).first()
    cuts = {m: sorted(set(row[m])) for m in MEASURES if row[m]}
    if not cuts:
        return []
    bins = [sum((F.col(m) > F.lit(c)).cast("int") for c in cs).alias(m) for m, cs in cuts.items()]
    counted = measured.select("quality", (F.col("part") == 0).alias("prune"), *bins).groupBy(*cuts).agg(
        *[F.sum(F.expr(f"CAST((quality = {q}) AND ({'NOT ' if p == 'grow' else ''}prune) AS INT)")).alias(f"{p}{q}") for p in ("grow", "prune") for q in (0, 1)])
    cells = sorted((tuple(r[m] for m in cuts), (r["grow0"], r["grow1"]), (r["prune0"], r["prune1"])) for r in counted.collect())
    return cover(cells, cuts)


def judge(df: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`statistics` of each row and kept: false if base_failed, else the list's verdict. Other columns are not kept."""
    return statistics(df, id_col, text_col).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = 2 * FIT_ROWS) -> DataFrame:
    """(text, quality, row) of labelled rows, about `rows` of them by a hash of their id, so that no more texts are gathered.
    Of several labels of a row the smallest counts. That number bounds what is broadcast."""
    n = labels.count()
    some = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 20)) < F.lit(int(min(1.0, rows / max(1, n)) * (1 << 20))))
    known = some.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality", F.col("doc_id").alias("row"))


def op5_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rules = fit(stored(labelled(docs, read(spark, sf_dir, "labels")), "quality-sample"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
