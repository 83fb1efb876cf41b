import public_tokenizers
from sparkweft.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_spliced_counts_equal_whole_counts():
    m = T.PieceModel(PATH)
    assert m.stable
    texts = ["hello world again and again " * 40, "a\n\n b  c   d▁e " * 60, "Èonai  aiai\tretion 漢字 🙂 " * 50, "x" * 700, " " * 500, "ab " * 3 + "y" * 400 + " z" * 90]
    for text in texts:
        for chunk, overlap in ((40, 4), (64, 16), (101, 30)):
            assert m.count(text, chunk, overlap) == len(m.model.encode(text)), (text[:20], chunk)


def test_nulls_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "two words", "z"), (3, "q " * 40000, "")], "doc_id long, text string, n_tokens string")
    rows = T.count_tokens(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0) for r in rows) == [(0, 9, True), (1, 0, False), (1, 0, False), (3, 80000, True)]
    assert [r.over_limit for r in rows if r.doc_id == 3] == [True]
    assert T.count_tokens(docs.limit(0), PATH).count() == 0


def test_the_query_against_the_library(spark, monkeypatch):
    """op7_token_counts with chunks so small that every text is spliced, and as it is."""
    import sentencepiece

    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = sorted((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in texts.items())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in T.op7_token_counts(spark, folder).collect()) == want
    m = T.PieceModel(PATH)
    for d, t in texts.items():
        for chunk, overlap in ((60, 8), (500, 40)):
            assert m.count(t or "", chunk, overlap) == len(library.encode(t or "")), d
    rows = T.op7_token_counts(spark, folder).where("over_limit").collect()
    assert {r.doc_id for r in rows} == {d for d, _, n in want if n > 4096}
