import pytest

from ontoloom.llm import encode

TEXTS = [None, "", " ", "\n\n  \t", "Hello world's end, it's 2024!", "Ünïcödé 権限は登録簿 🧾🏛️ \x07\x1b[31m", "<|endoftext|> is text", "a" * 5000, "word " * 20000, "نص عربي", "Hello world's end, it's 2024!"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id BIGINT, text STRING, ids STRING, words STRING")


@pytest.mark.parametrize("texts, words", [(512, 200_000), (2, 200_000), (512, 3)])
def test_ids_equal_the_tokenizer(documents, texts, words):
    coder = encode.encoding(f"{encode.vocabulary_folder()}/{encode.VOCABULARY}")
    got = {r.doc_id: list(r.ids) for r in encode.token_ids(documents, page_texts=texts, page_words=words).collect()}
    assert got == {i: coder.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_decode_gives_the_text_back(documents):
    got = {r.doc_id: r.text for r in encode.decoded(encode.token_ids(documents)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(documents):
    assert encode.token_ids(documents.limit(0)).count() == 0
