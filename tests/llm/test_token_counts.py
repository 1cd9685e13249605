import public_tokenizers
import sentencepiece

from palimpsest.llm.token_counts import count_tokens

TEXTS = ["", None, " ", "   ", "\n", "a\nb", " a  b ", "\n\n  x\r\n", "▁x ▁▁ y", "<s> </s> <unk>", "ﬁ ² 　 é é \x00 \x85", "日本語のテキスト " * 50, "word " * 9000, "x" * 3000, "tab\there  \n  next", "same", "same"]


def test_counts_equal_the_library(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, over_limit int")
    for r in count_tokens(df).collect():
        t = texts[r.doc_id] or ""
        want = len(library.encode(t)) if t else 0
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(t.encode()), want > 4096), t[:50]


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
