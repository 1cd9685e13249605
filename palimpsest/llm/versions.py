"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, and likeness from their difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACES, read, stored
from palimpsest.llm.quality import _let

#: Cells of a stored fingerprint, a multiple of 3. Tables for likeness have twice as many, four times, ...
CELLS = 24
#: Cells of the first table for two texts, for each paragraph of both; where peeling fails, the next has GROWTH times as many.
FIRST, GROWTH = 3, 2
#: A line longer than so many code points is cut at its sentences' ends into paragraphs: every line.
LONG_LINE = 0
#: Rounds of peeling a table; each takes out what is alone in a cell of the first third, then the second, then the last.
ROUNDS = 3
#: Digests whose cells are peeled together in one task, three entries each, and tasks at most; beyond these a task has more and
#: Spark's aggregates spill.
PER_TASK, MOST_TASKS = 1 << 18, 1 << 17
#: Documents of a block, in which each finds its successor; blocks at most.
BLOCK, MAX_BLOCKS = 1024, 1 << 14


def digests(text: Column) -> Column:
    """The different paragraphs' 64-bit digests. A paragraph is a sentence, or what of it is in one line, with a word."""
    cut = F.split(text, r"\n|(?<=[.!?])[^\S\n]+")
    return F.array_distinct(F.transform(F.filter(cut, lambda p: F.btrim(p, F.lit(SPACES)) != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    """What a cell adds up beside the keys, to tell one key from a sum of several."""
    return F.xxhash64(key, F.lit("check")).bitwiseAND(0xFFFFFFFF)


def _cells(key: Column, third: Column) -> list[Column]:
    """A key's cell in each third of the table."""
    return [(F.pmod(F.shiftright(F.xxhash64(key, F.lit("cell")), 20 * j).bitwiseAND(0xFFFFF), third) + j * third).cast("int") for j in range(3)]


def _element(key: Column, third: Column) -> Column:
    """A key with its check and its cells."""
    return F.struct(key.alias("k"), _check(key).alias("c"), *[x.alias(f"i{j}") for j, x in enumerate(_cells(key, third))])


def _by_cell(elements: Column, third: Column, cell) -> Column:
    """The table's cells in order: cell(i, its elements), an element being in one cell of each third."""
    def part(j: int) -> Column:
        at = F.sequence(third * j, third * (j + 1) - 1)
        return F.transform(at, lambda i: cell(i, F.filter(elements, lambda e: e[f"i{j}"] == i)))

    return F.concat(*[part(j) for j in range(3)])


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def sketch(keys: Column, cells: Column | int = CELLS) -> Column:
    """The table: of each cell the number of its keys, and the exclusive or of these and of their checks."""
    third = ((F.lit(cells) if isinstance(cells, int) else cells) / 3).cast("int")
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def added(_: Column, es: Column) -> Column:
        return F.aggregate(es, zero, lambda s, e: _cell(s["n"] + 1, s["k"].bitwiseXOR(e["k"]), s["c"].bitwiseXOR(e["c"])))

    return _let(F.transform(keys, lambda k: _element(k, third)), lambda es: _by_cell(es, third, added))


#: Places before a table's cells: what peeling has found on either side, and how many digests both texts have.
_OURS, _THEIRS, _SIZE, _FIRST = 0, 1, 2, 3


def _at(m: Column, place: Column) -> Column:
    """A table's number of cells and a place in it as one number, by which entries are added up."""
    return F.shiftleft(m.cast("long"), 32) + place


def _summed(entries: DataFrame, by: list[str], keep: bool) -> DataFrame:
    """Entries of the same place added up; empty cells go. Rows of one id are in one task already, so nothing is shuffled."""
    summed = entries.groupBy(*by, "at", *["found"] * keep).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return summed.filter(f"(at & 4294967295) < {_FIRST} OR n <> 0 OR k <> 0 OR c <> 0")


def _entry(at: Column, n: Column, k: Column, c: Column, found: Column | None = None) -> Column:
    return F.struct(at.alias("at"), n.cast("long").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"), *([] if found is None else [found.cast("long").alias("found")]))


def _subtracted(df: DataFrame, by: list[str], keep: bool) -> DataFrame:
    """The cells of the first sketch minus the second, of m cells each, as rows; a cell that both hold alike cancels out."""
    none, m = F.lit(None) if keep else None, F.col("m")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("a").alias("ks")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("ks")), F.struct(F.lit(0).alias("sign"), F.array((F.size("a") + F.size("b")).cast("long")).alias("ks"))))
    keys = df.select(*by, "m", sides.alias("s")).select(*by, "m", "s.sign", F.explode("s.ks").alias("key"))
    element = F.array(*[_entry(_at(m, x + _FIRST), F.col("sign"), F.col("key"), _check(F.col("key")), none) for x in _cells(F.col("key"), (m / 3).cast("int"))])
    size = F.array(_entry(_at(m, F.lit(_SIZE)), F.col("key"), F.lit(0), F.lit(0), none))
    return _summed(keys.select(*by, F.explode(F.when(F.col("sign") == 0, size).otherwise(element)).alias("e")).select(*by, "e.*"), by, keep)


def _peeled(entries: DataFrame, by: list[str], third_no: int, keep: bool) -> DataFrame:
    """What is alone in a cell of one third, as its check confirms, is taken out of its two other cells and put down as found.
    A key has one cell in a third, so none is taken out twice."""
    m, key, n, none = F.shiftright("at", 32), F.col("k"), F.col("n"), F.lit(None) if keep else None
    homes = [_at(m, x + _FIRST) for x in _cells(key, (m / 3).cast("int"))]
    alone = (F.abs("n") == 1) & (_check(key) == F.col("c")) & (homes[third_no] == F.col("at"))
    found = _entry(_at(m, F.when(n > 0, F.lit(_OURS)).otherwise(F.lit(_THEIRS))), F.lit(1), F.lit(0), F.lit(0), key if keep else None)
    out = [_entry(homes[j], -n, key, F.col("c"), none) for j in range(3) if j != third_no]
    itself = _entry(F.col("at"), n, key, F.col("c"), F.col("found") if keep else None)
    return _summed(entries.select(*by, F.explode(F.when(alone, F.array(found, *out)).otherwise(F.array(itself))).alias("e")).select(*by, "e.*"), by, keep)


def differing(pairs: DataFrame, by: list[str], keep: bool = False) -> DataFrame:
    """(by, cells, size, n_ours, n_theirs) of (by, a, b): how many digests of the arrays a and b the other lacks, from the
    difference of their sketches, how many cells that took and how many digests both have. `keep` adds the digests, as ours and
    theirs. The first of the `by` columns decides where a row is worked on.

    The two sketches are subtracted cell by cell and peeled; the first table has FIRST cells for each digest of both, and rows
    that peeling doesn't finish get one GROWTH times as large, and so on until none is left. Cells are rows of a table, so work
    and memory follow the number of digests. Rows of one id stay in one task: the arrays are shuffled once for each try. Pairs
    are read for each try, so they had better be a table.
    """
    pairs = pairs.select(*by, "a", "b")
    left = pairs.withColumn("m", (F.lit(CELLS) * F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2((F.size("a") + F.size("b") + 1) * FIRST / CELLS))))).cast("int"))
    done = None
    while True:
        total = left.agg(F.sum(F.size("a") + F.size("b"))).first()[0] or 0
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, total // PER_TASK))
        entries = _subtracted(left.repartition(tasks, by[0]), by, keep)
        for _ in range(ROUNDS):
            for j in range(3):
                entries = _peeled(entries, by, j, keep)
        place = F.col("at").bitwiseAND((1 << 32) - 1)
        n = lambda which: F.coalesce(F.sum(F.when(place == which, F.col("n"))), F.lit(0))
        sides = [F.collect_list(F.when(place == which, F.col("found"))).alias(name) for which, name in ((_OURS, "ours"), (_THEIRS, "theirs"))] if keep else []
        tried = entries.groupBy(*by).agg(F.max(F.shiftright("at", 32)).cast("int").alias("cells"), F.max(place).alias("last"), n(_SIZE).alias("size"), n(_OURS).alias("n_ours"), n(_THEIRS).alias("n_theirs"), *sides)
        tried = stored(tried, "fingerprint-peeled")
        ready = tried.filter(F.col("last") < _FIRST).drop("last")
        done = ready if done is None else done.unionByName(ready)
        failed = tried.filter(F.col("last") >= _FIRST).select(*by, (F.col("cells") * GROWTH).alias("m"))
        if failed.isEmpty():
            return done
        left = stored(pairs.join(failed, by), "fingerprint-retry")


def likeness(size: Column, n_ours: Column, n_theirs: Column) -> Column:
    """Twice the shared digests over all of both; 1 if both are empty."""
    return F.when(size == 0, F.lit(1.0)).otherwise(1.0 - (n_ours + n_theirs) / size)


def written(table: Column, keys: Column) -> Column:
    """A sketch as text: its cells, its number of keys, then each cell in hexadecimal, an empty one as a dot."""
    cells = F.transform(table, lambda c: F.when(c["n"] == 0, F.lit(".")).otherwise(F.concat(F.lower(F.hex(c["n"])), F.lit("-"), F.lower(F.hex(c["k"])), F.lit("-"), F.lower(F.hex(c["c"])))))
    return F.concat_ws(":", F.size(table).cast("string"), F.size(keys).cast("string"), F.concat_ws(" ", cells))


def _bounds(keys: DataFrame) -> list[int]:
    """First keys of blocks of about BLOCK rows, from approximate quantiles: at most MAX_BLOCKS numbers."""
    n, least = keys.agg(F.count("k"), F.min("k")).first()
    if not n:
        return []
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK))
    at = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else F.array(F.lit(0.0))
    found = keys.agg(F.percentile_approx("k", at, F.lit(max(10_000, 10 * blocks))).alias("q")).first()["q"]
    return sorted({least, *found})


def with_next(df: DataFrame, key: Column, columns: list[str], name: str = "next_{}") -> DataFrame:
    """df with the columns of the next row by ascending key (of the first one after the last).

    Keys are cut into blocks at values that some row has, so every block's first row is known by its key; it is sent to the
    block before as well, where it ends the order. One shuffle, and no task sees more than a block. Rows of one key follow
    each other in an order of their text columns. `row` is a number of each row's own.
    """
    keyed = df.withColumn("k", F.coalesce(key.cast("long"), F.lit(-(1 << 63))))
    bounds = _bounds(keyed.select("k"))
    if not bounds:
        return keyed.select(*df.columns, *[F.col(c).alias(name.format(c)) for c in columns], F.lit(0).cast("long").alias("row"))
    known = F.array(*[F.lit(b) for b in bounds])
    steps, s = [], 1
    while s < len(bounds):
        steps.insert(0, s)
        s *= 2
    block = F.lit(0)
    if steps:
        block = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, x: F.when((at + x < len(bounds)) & (F.get(known, at + x) <= F.col("k")), at + x).otherwise(at))
    homes = F.when(F.get(known, F.col("b")) == F.col("k"), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("late")), F.struct(F.pmod(F.col("b") - 1, F.lit(len(bounds))).alias("b"), F.lit(1).alias("late"))))
    homes = homes.otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("late"))))
    sent = keyed.withColumn("b", block).withColumn("home", F.explode(homes)).drop("b").select(*df.columns, "k", "home.b", "home.late")
    w = Window.partitionBy("b").orderBy("late", "k", *columns)
    row = (F.shiftleft(F.col("b").cast("long"), 40) + F.row_number().over(w)).alias("row")
    return sent.select(*df.columns, "late", *[F.lead(c).over(w).alias(name.format(c)) for c in columns], row).filter("late = 0").drop("late")


def versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited_as=lambda c: c) -> DataFrame:
    """Per row: doc_id, n_chars, edited (its second half replaced by as much of the next document's beginning), fingerprint,
    edited_fingerprint, near_edited, near_next, and cells_edited and cells_next, the sizes of the tables that were peeled.

    A null text is empty. Of one document the next is itself. A null id comes first, rows of one id go by their text, ids are
    whole numbers; an empty table gives no rows; other columns of df are neither read nor kept. Likeness counts paragraphs: a
    text of one paragraph is like its edited version not at all. `edited_as` is what is kept of the edited text (a digest, say).
    Texts are shuffled once and digests once for each try of peeling.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pairs = with_next(docs, F.col("doc_id"), ["t"])
    half = F.floor(F.char_length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.char_length("t") - half), F.substring("next_t", F.lit(1), half))
    cut = pairs.select("row", "doc_id", F.char_length("t").cast("long").alias("n_chars"), digests(F.col("t")).alias("own"), edited.alias("edited"), digests(F.col("next_t")).alias("next"))
    cut = cut.select("row", "doc_id", "n_chars", edited_as(F.col("edited")).alias("edited"), "own", digests(F.col("edited")).alias("new"), "next")
    cut = stored(cut, "fingerprint-digests")
    asked = cut.select("row", F.explode(F.array(*[F.struct(F.lit(which).alias("which"), F.col("own").alias("a"), F.col(other).alias("b")) for which, other in ((0, "new"), (1, "next"))])).alias("p")).select("row", "p.*")
    found = differing(asked, ["row", "which"])
    near = likeness(F.col("size"), F.col("n_ours"), F.col("n_theirs"))
    of = lambda which, value: F.max(F.when(F.col("which") == which, value))
    nears = found.groupBy("row").agg(of(0, near).alias("near_edited"), of(1, near).alias("near_next"), of(0, F.col("cells")).alias("cells_edited"), of(1, F.col("cells")).alias("cells_next"))
    prints = cut.select("row", "doc_id", "n_chars", "edited", "own", "new")
    return prints.join(nears, "row").select(
        "doc_id", "n_chars", "edited", written(sketch(F.col("own")), F.col("own")).alias("fingerprint"), written(sketch(F.col("new")), F.col("new")).alias("edited_fingerprint"), "near_edited", "near_next", "cells_edited", "cells_next"
    )


def op8_fingerprints(spark, sf_dir):
    found = versions(read(spark, sf_dir, "documents"), edited_as=lambda c: F.sha2(c, 256))
    return found.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next")
