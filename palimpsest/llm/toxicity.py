"""Toxicity scores of texts restored by a noisy-channel decoder."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, discard, read, stored
from palimpsest.llm.language import remainder

# The letters that a symbol is commonly written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "*": "aeiou", "#": "aeiou", "%": "o",
}
#: Natural logarithms of the channel: a letter for a symbol, a symbol that stands for nothing, a letter said again.
SUBSTITUTED, DROPPED, REPEATED = -1.0, -4.0, -0.7
#: Labelled rows that the lexicon is learned from, as expected by a hash of text and id: the fit's bound.
FIT_ROWS = 12_000
#: Windows of letters that make up no more than this share of all are left to the shorter contexts.
RARE = 1e-6
#: Entries of the lexicon: at most so many, by evidence.
LEXICON = 4_000
#: An entry of the lexicon is in so many labelled documents at least. It tells the classes apart by a likelihood ratio (G2) of
#: twice the logarithm of the number of candidates, which chance alone reaches once or so, and this much more.
LEAST_DOCS, SURPLUS = 3, 2.0
#: Lengths of the word beginnings that may be entries as well, so that rare words of one stem count together.
STEMS = (4, 5)
#: Letters of context of the language model.
CONTEXT = 3
#: Distinct tokens that a Python worker remembers the restored words of.
REMEMBERED = 1 << 19

_EDGE = "".join(sorted(set(".,;:?!\"'()[]{}<>|*#%&$+=~^`_-/\\…“”„«»–—¿¡")))
_RUN, _TWICE = re.compile(r"(.)\1\1+"), re.compile(r"(.)\1")
_MARKS = re.compile(r"([^\w\s])\1{2,}$")


def windows(word: str) -> list[str]:
    """Each letter of a word and its end, with the CONTEXT letters before it."""
    padded = "\x02" * CONTEXT + word + "\x03"
    return [padded[i - CONTEXT : i + 1] for i in range(CONTEXT, len(padded))]


class Letters:
    """A language model of letters in words: interpolated counts of contexts up to CONTEXT letters, words weighing by count."""

    def __init__(self, words: Iterable[tuple[str, int]] = (), grams: Iterable[tuple[str, int]] | None = None):
        """From words with counts, or from counts of their grams (windows), of which those of shorter contexts follow."""
        self.counts: list[dict[str, Counter]] = [{} for _ in range(CONTEXT + 1)]
        for gram, n in (((g, n) for w, n in words for g in windows(w)) if grams is None else grams):
            for order in range(CONTEXT + 1):
                self.counts[order].setdefault(gram[CONTEXT - order : CONTEXT], Counter())[gram[CONTEXT]] += n
        self.totals = [{c: (sum(k.values()), len(k)) for c, k in by.items()} for by in self.counts]
        self.known: dict[tuple[str, str], float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def log(self, context: str, letter: str) -> float:
        """Log-probability of a letter after CONTEXT letters (Witten and Bell's smoothing)."""
        if (found := self.known.get((context, letter))) is None:
            p = 1e-5
            for order in range(CONTEXT + 1):
                c = context[CONTEXT - order :]
                if c in self.totals[order]:
                    n, kinds = self.totals[order][c]
                    p = (self.counts[order][c][letter] + kinds * p) / (n + kinds)
            if len(self.known) > 1 << 18:
                self.known.clear()
            found = self.known[context, letter] = math.log(p)
        return found


def _pieces(path: tuple | None) -> list[str]:
    out = []
    while path:
        path, piece = path
        out.append(piece)
    return out[::-1]


class Channel:
    """Restores tokens: the likeliest word that could have been written so, by Viterbi over a lattice of characters."""

    def __init__(self, letters: Letters):
        self.letters = letters
        self.known: dict[str, str] = {}

    def lattice(self, token: str) -> list[tuple[tuple[str, float], ...]]:
        """For each run of one character, what it may stand for. A run of letters is one, or two, of them; a symbol
        is one of its letters or nothing."""
        out = []
        for c, run in itertools.groupby(token):
            n = len(list(run))
            if c.isalpha():
                out.append(((c, 0.0 if n == 1 else REPEATED), *(((c + c, 0.0 if n == 2 else REPEATED),) if n > 1 else ())))
            else:
                kinds = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
                out.append((*kinds, *((x + x, SUBSTITUTED + REPEATED) for x, _ in kinds if n > 1), ("", DROPPED if kinds else 0.0)))
        return out

    def decode(self, token: str, bounds: bool = False) -> str:
        """The best path through the token's lattice; the state is the last CONTEXT letters, so none better is left out.

        With bounds, a mark or space may also end a word and begin another, at the cost of a mark that stands for nothing; the
        words are parted by a space. Paths are kept as links to what they continue, so a token's length counts once.
        """
        log, start = self.letters.log, "\x02" * CONTEXT
        states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
        for (c, _), options in zip(itertools.groupby(token), self.lattice(token), strict=True):
            after: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for piece, cost in options:
                    s, at = score + cost, state
                    for letter in piece:
                        s += log(at, letter)
                        at = at[1:] + letter
                    if at not in after or s > after[at][0]:
                        after[at] = (s, (path, piece) if piece else path)
                if bounds and state != start and not c.isalnum():
                    s = score + options[-1][1] + log(state, "\x03")
                    if start not in after or s > after[start][0]:
                        after[start] = (s, (path, " "))
            states = after
        ends = [(score if bounds and at == start and path else score + log(at, "\x03"), path) for at, (score, path) in states.items()]
        best = max(s for s, _ in ends)
        return max("".join(_pieces(path)) for s, path in ends if s == best).strip(" ")

    def restore(self, token: str) -> str:
        """The words that a token is, parted by spaces: itself without the marks at its edges, or what the channel decodes. ""
        if it has no letter.

        Every token with more than one path is decoded: one that mixes letters with symbols, or says a letter twice. Numbers
        and marks alone are no words.
        """
        if (found := self.known.get(token)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[token] = self._restore(token)
        return found

    def _restore(self, token: str) -> str:
        body = _MARKS.sub("", token)
        bare = body.strip(_EDGE)
        if not any(map(str.isalpha, bare)):
            return ""
        at = body.index(bare)
        front, last = body[:at][-1:], body[at + len(bare) :][:1]
        alpha = bare.isalpha()
        plain = alpha and not _RUN.search(bare)
        if alpha and front not in LEET and not _TWICE.search(bare):
            return bare
        written = _RUN.sub(r"\1\1\1", front + bare if front in LEET else bare)
        readings = [self.decode(written, True)]
        if plain and front in LEET:
            readings.append(bare)
        elif not alpha and last in LEET:
            readings.append(self.decode(written + last, True))
        return max(readings, key=self.score)

    def score(self, words: str) -> float:
        """Log-probability of words parted by spaces, for each letter and end of a word."""
        total = 0.0
        for word in words.split(" "):
            at = "\x02" * CONTEXT
            for letter in word + "\x03":
                total += self.letters.log(at, letter)
                at = at[1:] + letter
        return total / (len(words) + 1)

    def words(self, text: str) -> set[str]:
        """The different restored words of a text. Single characters in a row are spaced-out words, besides."""
        tokens = text.lower().split()
        found = {word for token in set(tokens) for word in self.restore(token).split(" ")}
        singles = [i for i, t in enumerate(tokens) if len(t) == 1]
        for _, group in itertools.groupby(enumerate(singles), lambda x: x[1] - x[0]):
            run = [tokens[i] for _, i in group]
            if len(run) > 2 and any(map(str.isalpha, run)):
                found.update(self.restore(" ".join(run)).split(" "))
        found.discard("")
        return found

    def entries(self, text: str) -> set[str]:
        """The different restored words of a text and their stems, which end in a star."""
        words = self.words(text)
        return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


class Model:
    """Channel, lexicon (word or stem to weight) and the two numbers that make a probability of the largest weight met.

    The largest, not the sum: a long text meets more words by chance, but not heavier ones.
    """

    def __init__(self, words: list[tuple[str, int]] | Letters, lexicon: dict[str, float], slope: float = 1.0, offset: float = 0.0):
        self.lexicon, self.slope, self.offset = lexicon, slope, offset
        self.letters = words if isinstance(words, Letters) else Letters(words)
        self._channel: Channel | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_channel": None}

    def channel(self) -> Channel:
        """One for each process that has the model, so that tokens restored by one task are known to the next."""
        if self._channel is None:
            self._channel = Channel(self.letters)
        return self._channel

    def evidence(self, channel: Channel, text: str) -> float:
        known = self.lexicon
        return max((known[e] for e in channel.entries(text) if e in known), default=0.0)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.offset))))


def _map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _platt(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one number, with a small penalty, by Newton's steps that never climb."""
    counted = Counter(points)

    def parts(slope: float, offset: float) -> tuple[float, ...]:
        loss, g0, g1, h00, h01, h11 = 0.5 * (0.01 * offset * offset + (slope - 1) ** 2), 0.01 * offset, slope - 1, 0.01, 0.0, 1.0
        for (x, y), n in counted.items():
            z = slope * x + offset
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
            loss += n * (math.log1p(math.exp(-abs(z))) + max(z, 0.0) - y * z)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        return loss, g0, g1, h00, h01, h11

    slope, offset = 1.0, -2.0
    for _ in range(100):
        loss, g0, g1, h00, h01, h11 = parts(slope, offset)
        det = h00 * h11 - h01 * h01
        d0, d1, step = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det, 1.0
        while step > 1e-6 and parts(slope - step * d1, offset - step * d0)[0] > loss:
            step /= 2
        slope, offset = slope - step * d1, offset - step * d0
        if step <= 1e-6 or abs(d0) + abs(d1) < 1e-7:
            break
    return slope, offset


def letter_counts(texts: DataFrame) -> list[tuple[str, int]]:
    """Counts of the windows of letters in all words of the column `text`, over all its rows, words weighing by how often they
    occur. Words are counted first, combined before the shuffle. The driver gets the windows that make up more than RARE of all,
    which are less than 1 / RARE, whatever the corpus."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).filter(F.char_length("word").between(2, 24))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            counts: Counter = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in windows(w):
                    counts[g] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    grams = stored(_map_texts(counted, run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "toxic-letters")
    total = grams.agg(F.sum("n")).first()[0] or 0
    found = sorted((r["gram"], r["n"]) for r in grams.filter(F.col("n") > total * RARE).collect())
    discard(grams)
    return found


def fit(labelled: DataFrame, corpus: DataFrame | None = None) -> Model:
    """A model from the rows of (text, toxic 0 or 1); null texts and labels teach nothing. The letters' model is counted over all
    texts of `corpus` (without it, of the labelled rows), of which no labels are asked.

    About FIT_ROWS labelled rows, taken by a hash of the row, are read whole. What comes to the driver are the windows of
    letter_counts, LEXICON entries at most, and the largest weight that each text of the sample meets.
    """
    letters = Letters(grams=letter_counts(labelled if corpus is None else corpus))
    known = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isNotNull()).select(F.col("text").cast("binary").alias("t"), F.col("toxic").cast("int").alias("y"), (F.col("row") if "row" in labelled.columns else F.xxhash64("text")).alias("row"))
    n = known.count()
    sample = known.filter(F.pmod(F.xxhash64("t", "row", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 20)))).select("t", "y")
    shared = labelled.sparkSession.sparkContext.broadcast(Model(letters, {}))

    def restored_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        channel = shared.value.channel()
        for b in batches:
            docs: Counter = Counter()
            toxic: Counter = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [*channel.entries(t.decode("utf-8", "replace")), ""]
                docs.update(found)
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([toxic[w] for w in docs], pa.int64())], ["word", "n", "n_toxic"])

    met = _map_texts(sample, restored_words, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    met = met.filter((F.col("n") >= LEAST_DOCS) | (F.col("word") == ""))
    total = met.filter("word = ''").first()
    if total is None or total["n_toxic"] in (0, total["n"]):
        return Model(letters, {}, 1.0, -40.0 if total is None or not total["n_toxic"] else 40.0)
    n, toxic = total["n"], total["n_toxic"]

    def term(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    k, kt = F.col("n"), F.col("n_toxic")
    cells = [(kt, k * toxic / n), (k - kt, k * (n - toxic) / n), (toxic - kt, (n - k) * toxic / n), (n - toxic - k + kt, (n - k) * (n - toxic) / n)]
    least = 2 * math.log(max(2, met.count())) + SURPLUS
    scored = met.filter("word <> ''").withColumn("g2", 2 * sum(term(*c) for c in cells)).filter(F.col("g2") >= least).filter(kt / k > toxic / n)
    best = scored.orderBy(F.desc("g2"), "word").limit(LEXICON).collect()
    def weight(k: int, kt: int, n: int, toxic: int) -> float:
        return math.log((kt + 0.5) / (toxic + 1)) - math.log((k - kt + 0.5) / (n - toxic + 1))

    seen = {r["word"]: (r["n"], r["n_toxic"]) for r in best}
    counted = labelled.sparkSession.sparkContext.broadcast((Model(letters, {}), seen))

    def left_out(batches: Iterator) -> Iterator:
        """Each text's evidence by the weights that the other texts give: what a text adds to its own words tells nothing."""
        import pyarrow as pa

        m, known = counted.value
        for b in batches:
            ys = b.column(1).to_pylist()
            found = [[known[e] for e in m.channel().entries(t.decode("utf-8", "replace")) if e in known] for t in b.column(0).to_pylist()]
            x = [max((weight(k - 1, kt - y, n - 1, toxic - y) for k, kt in f), default=0.0) for f, y in zip(found, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "y"])

    points = [(r["x"], r["y"]) for r in _map_texts(sample, left_out, "x double, y int").select(F.round("x", 3).alias("x"), "y").collect()]
    return Model(letters, {w: weight(k, kt, n, toxic) for w, (k, kt) in seen.items()}, *_platt(points))


def _scored(df: DataFrame, model: Model, text: str, key: str, more: list[str] = ()) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [key, *more]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        channel = m.channel()
        for b in batches:
            x = [m.evidence(channel, (t or b"").decode("utf-8", "replace")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.float64()), pa.array([m.score(e) for e in x], pa.float64())], [*rest, "x", "score"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return _map_texts(df.select(F.col(text).cast("binary").alias("t"), *rest), run, f"{kinds}, x double, score double")


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts have no words and get the
    score of no evidence. Other columns are neither read nor kept. No shuffle."""
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return _scored(named, model, "t", "doc_id").select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose score is under the threshold, unchanged. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        channel = m.channel()
        for b in batches:
            low = [m.score(m.evidence(channel, (t or b"").decode("utf-8", "replace"))) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(low, pa.bool_()))

    named = df.select(*[(F.col(c).cast("binary") if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    out = _map_texts(named, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema))
    return out.select(*[F.col(f"c{i}").cast(df.schema[c].dataType).alias(c) for i, c in enumerate(df.columns)])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(text, toxic, row) of the rows that may teach: crc32 of the id as text modulo 5 isn't 0. Of several labels of a row the
    largest counts; row is a hash of the id.

    The labels are broadcast, so they have to be a bounded number (sampled_labels).
    """
    known = labels.filter(teaches(id_col) & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    return docs.select(id_col, "text").join(F.broadcast(known), id_col).select("text", "toxic", F.xxhash64(id_col).alias("row"))


def teaches(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 5) != 0, F.lit(True))


def learned(spark, sf_dir: str) -> Model:
    """The model that a folder's documents and labels teach; the sampled texts are a table, read by each pass of the fit. Letters
    are counted over all documents that may teach."""
    docs = read(spark, sf_dir, "documents")
    sample = stored(labelled(docs, sampled_labels(read(spark, sf_dir, "labels"))), "toxic-sample")
    model = fit(sample, docs.filter(teaches()).select("text"))
    discard(sample)
    return model


def sampled_labels(labels: DataFrame, rows: int = 2 * FIT_ROWS) -> DataFrame:
    """About so many of the labels, by a hash of their id, so that no more texts than those are gathered."""
    n = labels.count()
    return labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 20)) < F.lit(int(min(1.0, rows / max(1, n)) * (1 << 20))))


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, learned(spark, sf_dir)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
