"""Removal of word sequences that an earlier place already has: winnowed anchors as seeds, extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import bounded_batches, read, stored

#: Words of a window, and of an anchor. Any window holds WIDTH anchors' places, a power of two.
WINDOW, ANCHOR = 20, 5
WIDTH = WINDOW - ANCHOR + 1
#: Distinct words that a Python worker remembers the hashes of, and words that it takes at a time (more if one text has more).
REMEMBERED, AT_ONCE = 1 << 18, 1 << 18
#: The share of all words that starts a common phrase, and the least number. Any choice gives the same result; this one keeps tasks even.
COMMON, LEAST = 1e-5, 8
#: Cells that phrases are counted in before they are by themselves, and how many of them are a row.
CELLS, CELLS_A_ROW = 1 << 20, 1 << 16
#: A null document id sorts before all others.
NULL_ID = -(1 << 63)

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finalizer: every bit of x counts for every bit of the result."""
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Rolled:
    """Hashes of any run of words of some texts, from prefix sums of a polynomial modulo 2^64 with odd base."""

    def __init__(self, words: np.ndarray, which: int):
        n, base = len(words), _BASES[which]
        self.which = which
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(words, which + 1) * np.multiply.accumulate(up)[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts], 0x51ED + self.which)


def _hashed(texts: list[bytes | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as 64-bit hashes, and where each text's begin."""
    if len(cache) > REMEMBERED:
        cache.clear()
    parts, firsts = [], [0]
    for t in texts:
        words = (t or b"").split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        firsts.append(firsts[-1] + len(words))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(firsts)


def _parts(texts: list[bytes | None], cache: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in turn, so many that they have about AT_ONCE words: which one is the first, the words and where each text's begin."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= 8 * AT_ONCE or i + 1 == len(texts):
            yield at, *_hashed(texts[at : i + 1], cache)
            at, size = i + 1, 0


def _runs(words: np.ndarray, firsts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window's start, number of windows, anchor's hash, extended match's hash) of each selected anchor.

    A window selects the leftmost least of its anchors' hashes, common ones last; neighbours that select the same place form a run. The match
    of an anchor, extended to both sides as far as windows select it, is the run's words; its hash also tells where the anchor is.
    """
    empty = np.zeros(0, np.int64)
    n = len(words)
    if n < WINDOW:
        return empty, empty, empty, empty, empty
    at = np.arange(n - ANCHOR + 1)
    grams = Rolled(words, 0).of(at, at + ANCHOR)
    value, place, step = grams, at, 1
    if len(common):
        late = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
        value = (grams >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    while step < WIDTH:
        left, right = value[:-step], value[step:]
        first = left <= right
        value, place = np.where(first, left, right), np.where(first, place[:-step], place[step:])
        step *= 2
    text = np.searchsorted(firsts, np.arange(len(value)), "right") - 1
    valid = np.flatnonzero(np.arange(len(value)) + WINDOW <= firsts[text + 1])
    if not len(valid):
        return empty, empty, empty, empty, empty
    text, place = text[valid], place[valid]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    start, size = valid[new], np.diff(np.append(new, len(valid)))
    anchor, text = place[new], text[new]
    match = Rolled(words, 1).of(start, start + size + WINDOW - 1)
    match = _mixed(match + (anchor - start).astype(np.uint64) * np.uint64(64) + size.astype(np.uint64), 0xA17)
    return text, start - firsts[text], size, grams[anchor].view(np.int64), match.view(np.int64)


def _settled(keys: list[np.ndarray], ids: np.ndarray, subs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys: which one is first by (id, sub, pos) and goes on, and which come after one, so are copies."""
    order = np.lexsort([pos, subs, ids, *keys])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    copy = (ids[order] != ids[lead]) | (subs[order] != subs[lead]) | (pos[order] != pos[lead])
    return order[head], order[copy & ~head]


_ROWS = "settled boolean, a long, b long, doc long, sub int, pos int, n int"


def _batch(a, b, ids, subs, pos, n):
    """Arrow rows: those that go on, by their keys, and copies found in this batch, under keys that spread them."""
    import pyarrow as pa

    go, copies = _settled([b, a], ids, subs, pos)
    spread = (ids[copies] * 1_000_003 + pos[copies]).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(len(go), bool), np.ones(len(copies), bool)])),
            pa.array(np.concatenate([a[go], spread])), pa.array(np.concatenate([b[go], np.zeros(len(copies), np.int64)])),
            pa.array(np.concatenate([ids[go], ids[copies]])), pa.array(np.concatenate([subs[go], subs[copies]]).astype(np.int32)),
            pa.array(np.concatenate([pos[go], pos[copies]]).astype(np.int32)), pa.array(np.concatenate([n[go], n[copies]]).astype(np.int32)),
        ],
        ["settled", "a", "b", "doc", "sub", "pos", "n"],
    )


def _names(batch) -> tuple[np.ndarray, np.ndarray]:
    return (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sub"))


def anchors(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """One row for each selected anchor of (doc, sub, t, ...): a its hash, b its extended match's, where and how many windows."""

    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator) -> Iterator:
        cache = WordHashes()
        for batch in batches:
            parts = []
            for at, words, firsts in _parts(batch.column("t").to_pylist(), cache):
                text, *found = _runs(words, firsts, shared.value)
                parts.append((text + at, *found))
            if not parts:
                continue
            text, pos, n, a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
            ids, subs = _names(batch)
            yield _batch(a, b, ids[text], subs[text], pos, n)

    return docs.mapInArrow(run, _ROWS)


def window_rows(docs: DataFrame) -> DataFrame:
    """One row for each window of the runs in `spans` of (doc, sub, t, spans, ...): a and b are its digest of 128 bits."""

    def run(batches: Iterator) -> Iterator:
        cache = WordHashes()
        for batch in batches:
            words, firsts = _hashed(batch.column("t").to_pylist(), cache)
            (ids, subs), starts, owner = _names(batch), [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                for s in spans or ():
                    starts.append(np.arange(s["pos"], s["pos"] + s["n"]))
                    owner.append(np.full(s["n"], i))
            if starts:
                pos, owner = np.concatenate(starts), np.concatenate(owner)
                at = pos + firsts[owner]
                a, b = (Rolled(words, w).of(at, at + WINDOW).view(np.int64) for w in (1, 2))
                yield _batch(a, b, ids[owner], subs[owner], pos, np.ones(len(pos), np.int64))

    return docs.mapInArrow(run, _ROWS)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "sub").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def _after_first(*keys: str):
    place = F.struct("doc", "sub", "pos")
    return place > F.min(place).over(Window.partitionBy("settled", *keys))


def _phrases(batches: Iterator) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the hashes of ANCHOR-word phrases, for about AT_ONCE words at a time."""
    cache = WordHashes()
    for batch in batches:
        for _, words, firsts in _parts(batch.column("t").to_pylist(), cache):
            at = np.arange(max(0, len(words) - ANCHOR + 1))
            at = at[at + ANCHOR <= firsts[np.searchsorted(firsts, at, "right")]]
            yield len(words), Rolled(words, 0).of(at, at + ANCHOR)


def _cells(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of words of all texts, and how many phrases' places fall into each of CELLS cells. A task gives as many rows
    whatever it reads."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        size, cells = 0, np.zeros(CELLS, np.int64)
        for n, grams in _phrases(batches):
            size += n
            cells += np.bincount((grams % np.uint64(CELLS)).view(np.int64), minlength=CELLS)
        if size:
            parts = [np.array([size]), *cells.reshape(-1, CELLS_A_ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())], ["part", "cells"])

    def added(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for part, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(cells, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["part", "cells"])

    rows = docs.select("t").mapInArrow(run, "part int, cells binary").repartition(CELLS // CELLS_A_ROW, "part").mapInArrow(added, "part int, cells binary")
    sums = [np.frombuffer(r.cells, np.int64) for r in sorted(rows.collect(), key=lambda r: r.part)]
    return (int(sums[0][0]), np.concatenate(sums[1:])) if sums else (0, np.zeros(CELLS, np.int64))


def _counted(docs: DataFrame, few: np.ndarray) -> DataFrame:
    """(gram, n): how often phrases of cells that aren't among the `few` are met, a row for each in about AT_ONCE words."""
    shared = docs.sparkSession.sparkContext.broadcast(~few)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, grams in _phrases(batches):
            gram, count = np.unique(grams[shared.value[(grams % np.uint64(CELLS)).view(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64), pa.int64()), pa.array(count, pa.int64())], ["gram", "n"])

    return docs.select("t").mapInArrow(run, "gram long, n long")


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes, ascending, of ANCHOR-word phrases: all that have half of COMMON of all words' places (half of LEAST places at least).

    Every text is read, twice. First places are counted in cells by the phrases' hashes, in as many rows a task whatever it reads.
    Then the phrases of cells with enough places, in which all common ones are, are counted by themselves; at most 2 / COMMON
    phrases are kept, whatever the corpus.
    """
    size, cells = _cells(docs)
    least = max(LEAST, COMMON * size)
    rows = _counted(docs, 2 * cells < least).groupBy("gram").agg(F.sum("n").alias("n")).filter(2 * F.col("n") >= least).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().view(np.uint64))


def _repeats(docs: DataFrame) -> DataFrame:
    """(doc, sub, spans): the windows, as (pos, n) for n from word pos on, whose words also start earlier. docs: (doc, sub, t, ...).

    Two windows of equal words select the same anchor at the same place in them, so they meet on its hash. Where the extended
    matches around it are the same too, all windows of the run are, and all runs but the first are copies. Only where an
    anchor has several extended matches are the windows of each one's first run compared one by one, by digests of
    128 bits. A batch settles its own copies before the shuffle, so a passage of a third of all documents is a row for
    each batch there. Common phrases come last in the order by which windows select, so that a phrase of a third of all
    documents with other words around it is no anchor there, and no task gets it. No pairs are formed.
    """
    common = common_anchors(docs)
    rows = anchors(docs, common).repartition("settled", "a")
    seen = Window.partitionBy("settled", "a")
    met = (
        rows.withColumn("copy", F.col("settled") | _after_first("a", "b"))
        .withColumn("lo", F.min("b").over(seen)).withColumn("hi", F.max("b").over(seen))
        .select("doc", "sub", "pos", "n", "copy", (~F.col("settled") & (F.col("lo") != F.col("hi"))).alias("several"))
        .filter("copy or several")
    )
    met = stored(met, "repeats")
    firsts = _spans(met.filter("several and not copy"))
    windows = window_rows(docs.join(firsts, ["doc", "sub"]))
    single = windows.withColumn("copy", F.col("settled") | _after_first("a", "b")).filter("copy")
    return _spans(met.filter("copy").select("doc", "sub", "pos", "n").union(single.select("doc", "sub", "pos", "n")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with n_words, n_removed, kept (the kept words, joined by one space) and repeats (maximal runs of removed words).

    Words are runs of anything but the six ASCII spaces. A word goes if a window of WINDOW words that covers it has the same
    words as one that starts earlier: in a smaller id, or in the same text before. Windows are judged on the input. A null text
    has no words; a null id sorts first. Ids are whole numbers (another type raises ValueError). Different texts of one id are
    texts of their own, in an order of a hash of theirs; rows that repeat an id and its text are that text, and get one result.
    An empty table stays empty; a text of any length is read whole. Columns of df with the added names are replaced.
    Beside the anchors (about one for eight words) the texts are shuffled once, by id, for both joins.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} has to be a whole number")
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("n_words", "n_removed", "kept", "repeats")]
    named = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(F.col(text_col)).alias("sub"), F.col(text_col).cast("binary").alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest) if c != text_col])
    found = _repeats(named)
    kept_columns = [c for c in named.columns if c not in ("doc", "sub", "t")]
    joined = named.join(found, ["doc", "sub"], "left").select("t", "spans", *kept_columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            counts, gone, kept, runs = [], [], [], []
            for t, spans in zip(b.column("t").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = (t or b"").split()
                merged: list[list[int]] = []
                for s in sorted((s["pos"], s["pos"] + s["n"] + WINDOW - 1) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                for s, e in reversed(merged):
                    del words[s:e]
                removed = sum(e - s for s, e in merged)
                counts.append(len(words) + removed)
                gone.append(removed)
                kept.append(b" ".join(words))
                runs.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("t", *kept_columns)], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["t", *kept_columns, "n_words", "n_removed", "kept", "repeats"],
            )

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "spans"] + ["n_words long", "n_removed long", "kept binary", "repeats array<struct<start:int,end:int>>"])
    names = {c: f"c{i}" for i, c in enumerate(rest) if c != text_col}
    out = joined.mapInArrow(run, schema)
    return out.select(*[(F.col("t").cast("string") if c == text_col else F.col(names[c])).alias(c) for c in rest], "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "repeats")


def op4_substrings(spark, sf_dir):
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sql(documents: str = "documents") -> str:
    """DuckDB's SQL for (doc_id, n_words, n_removed, kept) of the named relation."""
    return f"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {documents}),
windows AS (SELECT doc_id, pos, array_to_string(words[pos : pos + {WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM split)),
copies AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + {WINDOW})))) AS places FROM copies GROUP BY doc_id),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
holes AS (SELECT doc_id, unnest(places) AS pos FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN holes USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, coalesce(kept, '') AS kept
FROM split LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


SQL = f"SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM ({sql()})"
