"""SentencePiece encoding by a Viterbi pass over an Aho-Corasick automaton of the pieces, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, read
from palimpsest.llm.token_counts import MODEL, _path, check_boundaries

#: Distinct pre-tokens that a Python worker remembers the ids of, and code points of the longest such.
REMEMBERED, LONGEST = 1 << 19, 48
#: A code point that no piece covers costs this much more than the worst piece, and becomes byte pieces.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Runs that no piece crosses: a space mark is only ever at the front of a piece. A literal mark stands alone.
PRE_TOKEN = re.compile(r"▁| *[^ \n▁]+|\n| +")


class Pieces:
    """The vocabulary of a model file as an automaton with scores, and its inverse.

    encode() finds the segmentation of the highest sum of scores (the model file's, taken as additive). At each place the
    automaton's state gives the longest piece that ends there, its output links all shorter ones; each relaxes the best
    score that the text up to there has. Of equal scores the longer last piece wins. A space becomes the mark U+2581
    and one is put in front. What no piece covers becomes the pieces of its UTF-8 bytes; so does a literal U+2581, which
    the mark would otherwise turn into a space: decode() gives back every text exactly.
    """

    def __init__(self, model: str = MODEL):
        import ahocorasick
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=_path(model))
        check_boundaries(processor)
        n = processor.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.known: dict[str, bytes] = {}
        scores = []
        for i in range(n):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                scores.append(score := processor.get_score(i))
                self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.single = {p for p in self.automaton if len(p) == 1}
        self.unknown = min(scores) - UNKNOWN_PENALTY

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids and score of one run of text whose spaces are marks already."""
        n = len(text)
        score, back = [0.0] + [-float("inf")] * n, [(0, 0)] * (n + 1)
        at = 0

        def unknown(upto: int) -> None:
            nonlocal at
            for k in range(at, upto):
                if text[k] not in self.single and score[k] + self.unknown > score[k + 1]:
                    score[k + 1], back[k + 1] = score[k] + self.unknown, (1, -1)
            at = max(at, upto)

        for end, (size, piece, s) in self.automaton.iter(text):
            if end >= at:
                unknown(end + 1)
            if (new := score[end + 1 - size] + s) > score[end + 1]:
                score[end + 1], back[end + 1] = new, (size, piece)
        unknown(n)
        ids, k = [], n
        while k:
            size, piece = back[k]
            ids += [piece] if piece >= 0 else [self.byte_ids[x] for x in reversed(text[k - 1].encode())]
            k -= size
        return ids[::-1], score[n]

    def _packed(self, run: str) -> bytes:
        if (found := self.known.get(run)) is None:
            ids = [self.byte_ids[x] for x in run.encode()] if run == SPACE else self.best(run.replace(" ", SPACE))[0]
            found = np.array(ids, np.int32).tobytes()
            if len(run) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as packed int32; the best of a text is the best of its runs, each found once while remembered."""
        if not text:
            return b""
        known, packed = self.known, self._packed
        return b"".join([known.get(r) or packed(r) for r in PRE_TOKEN.findall(" " + text)])

    def decode(self, ids: list[int]) -> str:
        """The text, without the space put in front; bytes that are no UTF-8 become U+FFFD; control pieces are nothing."""
        table = self.bytes
        text = b"".join([table[i] for i in ids])
        return text.removeprefix(b" ").decode("utf-8", "replace")


def encode(df: DataFrame, text_col: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """df with ids (array<int>), n_pieces (long) and, if asked for, round_trip: whether decoding gives the text again.

    A null text has null ids, 0 pieces and is a round trip; an empty one has no ids. Columns of df with these names are
    replaced. No shuffle.
    """
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("ids", "n_pieces", "round_trip")]
    named = df.select(*[(F.col(c).cast("binary") if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(rest)])
    text = rest.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = Pieces(model)
        for b in batches:
            raw = b.column(text).to_pylist()
            packed, same = [], []
            for t in raw:
                words = (t or b"").decode("utf-8", "replace")
                packed.append(p := pieces.encode(words))
                if verify:
                    same.append(pieces.decode(np.frombuffer(p, np.int32).tolist()) == words)
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*[t is None for t in raw], False]))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(sizes), *([pa.array(same, pa.bool_())] if verify else [])], [*b.schema.names, "ids", "n_pieces", *["round_trip"] * verify])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in named.schema] + ["ids array<int>", "n_pieces long"] + ["round_trip boolean"] * verify)
    out = named.mapInArrow(run, schema)
    return out.select(*[(F.col(f"c{i}").cast(df.schema[c].dataType) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(rest)], "ids", "n_pieces", *["round_trip"] * verify)


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df with decoded (string), the text of its ids; null ids give null. A column of df with that name is replaced."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c != "decoded"]
    named = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    at = rest.index(ids_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = Pieces(model)
        for b in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    out = named.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in named.schema] + ["decoded string"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "decoded")


def op2_encoding(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), verify=True).select("doc_id", "n_pieces", "ids", "round_trip")
