"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, read

ORDER = 3
#: Labelled rows per language that the trees are learned from, as expected by a hash of their text: the fit's bound.
ROWS_PER_LANGUAGE = 800
#: A context of ORDER bytes with one byte seen less often than this is left out of the trees; the fit's other bound is
#: the number of contexts, of which the most frequent stay (whole orders below ORDER first).
LEAST_COUNT, MAX_CONTEXTS = 2, 40_000
#: Bytes scored at once in a worker.
CHUNK = 1 << 19


def remainder(id_col: str, divisor: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, order, gram, n) of the rows of (lang, text): how often each byte follows each context of 0 to ORDER bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for order in range(ORDER + 1):
                    grams = []
                    for t in texts:
                        a = np.frombuffer(t, np.uint8).astype(np.int64)
                        if len(a) > order:
                            grams.append(sum(a[i : len(a) - order + i] << (8 * (order - i)) for i in range(order + 1)))
                    if grams:
                        g, n = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(np.full(len(g), order, np.int32)), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "ord", "gram", "n"])

    counts = labelled.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, ord int, gram long, n long")
    return counts.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).filter((F.col("ord") < ORDER) | (F.col("n") >= LEAST_COUNT))


class Trees:
    """The languages' context trees, frozen, as two tables.

    `state` maps the last three byte classes to the longest context that any tree holds; `cost[state, class, language]`
    is the code length in bits. A byte of count c in a context of n bytes and d distinct ones costs -log2(c / (n + d));
    one not seen there costs the escape -log2(d / (n + d)) and what it costs in the next shorter context; a context that a
    language's own tree lacks costs it nothing; below all contexts a byte costs 8 bits. Bytes seen in no training text share
    class 0, which is no context and always escapes to the bottom: code lengths are exact.
    """

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        lang = {x: i for i, x in enumerate(self.langs)}
        seen = sorted({r[2] for r in rows if r[1] == 0})
        self.classes = np.zeros(256, np.uint8 if len(seen) < 256 else np.uint16)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        a, n_langs = len(seen) + 1, len(self.langs)
        per: list[dict[int, int]] = [{} for _ in range(ORDER + 1)]
        for _, order, gram, n in rows:
            per[order][gram >> 8] = per[order].get(gram >> 8, 0) + n
        room, contexts = MAX_CONTEXTS, []
        for p in per:
            contexts.append(sorted(sorted(p, key=lambda c: (-p[c], c))[: max(0, room)]))
            room -= len(contexts[-1])
        self.state = np.zeros((a, a, a), np.int32)
        ids: list[dict[int, int]] = []
        total = 0
        for order, known in enumerate(contexts):
            ids.append({c: total + i for i, c in enumerate(known)})
            total += len(known)
            for c, i in ids[order].items():
                k = [int(self.classes[c >> (8 * j) & 255]) for j in reversed(range(order))]
                if order == 0:
                    self.state[:] = i
                else:
                    self.state[(slice(None),) * (3 - order) + tuple(k)] = i
        counts = np.zeros((total, a, n_langs), np.float32)
        for x, order, gram, n in rows:
            if (i := ids[order].get(gram >> 8)) is not None:
                counts[i, self.classes[gram & 255], lang[x]] = n
        self.cost = np.full((total, a, n_langs), 8.0, np.float32)
        at = 0
        for order, known in enumerate(contexts):
            here = slice(at, at + len(known))
            if known:
                c = counts[here]
                n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                lower = np.full_like(c, 8.0) if order == 0 else self.cost[[ids[order - 1][k & ((1 << (8 * (order - 1))) - 1)] for k in known]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = np.where(c > 0, -np.log2(c / (n + d)), -np.log2(d / (n + d)) + lower)
                self.cost[here] = np.where(n > 0, own, lower)
            at += len(known)
        self.cost = self.cost.reshape(total * a, n_langs)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        if not sizes.sum():
            return out
        now = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        firsts = starts[:-1][sizes > 0]

        def shifted(x: np.ndarray) -> np.ndarray:
            y = np.empty_like(x)
            y[0], y[1:] = 0, x[:-1]
            y[firsts] = 0
            return y

        c1 = shifted(now)
        c2 = shifted(c1)
        c3 = shifted(c2)
        flat, a = self.state.reshape(-1), self.state.shape[0]
        for s in range(0, len(now), CHUNK):
            e = min(len(now), s + CHUNK)
            place = (c3[s:e].astype(np.int32) * a + c2[s:e]) * a + c1[s:e]
            bits = self.cost.take(flat.take(place) * a + now[s:e], axis=0)
            lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e, "left")
            docs = np.arange(lo, hi)[np.minimum(starts[lo + 1 : hi + 1], e) > np.maximum(starts[lo:hi], s)]
            out[docs] += np.add.reduceat(bits, np.maximum(starts[docs], s) - s, axis=0, dtype=np.float64)
        return out


def fit(labelled: DataFrame) -> Trees:
    """Trees from a bounded sample of the rows of (lang, text, row); null languages and texts teach nothing.

    The sample takes rows by a hash of their text and of row (an id; without that column copies come or go together), at each
    language's own rate, so that about ROWS_PER_LANGUAGE of each
    are read, whole. What comes to the driver are counts, at most LEAST_COUNT and the sample's size permitting.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("text", *["row"] * ("row" in labelled.columns), F.lit("sample")), F.lit(1 << 20))
    keep = F.lit(False)
    for lang, n in rows.items():
        keep = keep | ((F.col("lang") == F.lit(lang)) & (share < F.lit(int(min(1.0, ROWS_PER_LANGUAGE / n) * (1 << 20)))))
    grams = gram_counts(known.filter(keep)).collect()
    return Trees(sorted((r["lang"], r["ord"], r["gram"], r["n"]) for r in grams))


def predict(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (the best language's share of the posterior), bits (the best code length).

    A null text and one without a letter get und and score 0, as do all if nothing was learned. Ties go to the language
    that sorts first.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = shared.value
        for b in batches:
            texts = [x if ok else b"" for x, ok in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if t.langs:
                bits = t.lengths(texts)
                best = bits.argmin(1)
                least = bits[np.arange(len(texts)), best]
                score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
            ok = [bool(x) and bool(t.langs) for x in texts]
            lang = [t.langs[best[i]] if y else "und" for i, y in enumerate(ok)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array([float(score[i]) if y else 0.0 for i, y in enumerate(ok)], pa.float64()), pa.array([float(least[i]) if y else 0.0 for i, y in enumerate(ok)], pa.float64())],
                ["doc_id", "lang_pred", "score", "bits"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("ok"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double")


def op3_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    trees = fit(docs.filter(~F.coalesce(held_out, F.lit(False))).select("lang", "text", F.col("doc_id").alias("row")))
    return predict(docs, trees).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
