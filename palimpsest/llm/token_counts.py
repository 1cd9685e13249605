"""Token counts of a SentencePiece model without ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, read

MODEL = "piece_bpe_32k.model"
#: Distinct pre-tokens that a Python worker remembers the counts of, and code points of the longest such.
REMEMBERED, LONGEST = 1 << 20, 64
#: No piece of the model goes on from a letter to a space mark, and none holds a line end; merges stay within these.
PRE_TOKEN = re.compile(r" *[^ \n]+|\n| +")


def _path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def check_boundaries(processor) -> None:
    """Raise if a piece of the model crosses a pre-token's edge, where counts of pre-tokens would not add up."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i)) and ("▁" in piece.lstrip("▁") or "\n" in piece):
            raise ValueError(f"piece {piece!r} crosses a pre-token's edge")


class PieceCounts(dict):
    """Pieces of each distinct pre-token, counted once; of a text, the sum over its pre-tokens' frequencies."""

    def __init__(self, model: str):
        super().__init__()
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=_path(model))
        check_boundaries(self.processor)

    def learn(self, new: Iterable[str]) -> None:
        """A pre-token that starts with a space is encoded as the library encodes a text, which gets that space in front;
        another one follows a line end, whose two pieces (the space mark and the byte) are not its own."""
        new = list(new)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            texts = [p[1:] if p[0] == " " else "\n" + p for p in some]
            for p, ids in zip(some, self.processor.encode(texts, num_threads=1), strict=True):
                self[p] = (len(ids) if len(p) > 1 or p != " " else 1) if p[0] == " " else len(ids) - 2

    def count(self, texts: list[str]) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        freqs = [Counter(PRE_TOKEN.findall(" " + t.replace("▁", " "))) if t else Counter() for t in texts]
        new = set().union(*freqs) - self.keys()
        self.learn(new)
        found = [sum(n * self[p] for p, n in f.items()) for f in freqs]
        for p in new:
            if len(p) > LONGEST:
                del self[p]
        return found


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = 4096) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit; other columns are neither read nor kept. A null text counts as empty.

    The library's count of a text is the sum of the counts of its pre-tokens. Each block of texts gets the frequencies
    of its pre-tokens, counts the pieces of those not met before once, joins and sums. This takes no shuffle; the
    table of counts is bounded (REMEMBERED) and starts again when full, which changes no result.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = PieceCounts(model)
        for b in batches:
            raw = b.column(1).to_pylist()
            n = []
            for at in range(0, len(raw), 256):
                n += counts.count([(x or b"").decode("utf-8", "replace") for x in raw[at : at + 256]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op1_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"))
