import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlens.llm.token_counts import safe_parts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False))


TEXTS = ["", None, "a", " ", "  ", " a", "a ", "a  b", "a \n b\n\nc  ", "it's we'll don't", "x<|endoftext|> y <|endoftext|>  z", "1 2  3\t4",
         "É à ü 漢字 漢 字", "a b   c　 d", "word " * 5000, "!!! ??? ... a.b,c", "\n\n a\n b", "\x1c a \x1d b", "x\u0085 y   z"]


def test_equals_library_on_whole_texts(spark, docs):
    got = {r.doc_id: r for r in token_counts(docs(list(enumerate(TEXTS)), extra=True), PATH).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].n_tokens == plain(text), repr(text)
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (plain(text) > 512)


def test_parts_join_to_the_text():
    for text in TEXTS:
        if text:
            assert "".join(safe_parts(text)) == text


def test_edges_and_empty_table(spark, docs, edge_rows):
    df = token_counts(docs(edge_rows), PATH)
    assert df.count() == len(edge_rows)
    assert token_counts(docs([]), PATH).count() == 0
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_sentence_pieces(spark, docs):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs([(1, "Hello big world"), (2, None)]), path).collect()}
    assert got == {1: len(model.encode("Hello big world")), 2: 0}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want
