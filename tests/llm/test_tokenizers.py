"""SentencePiece codes and token counts against the libraries."""

import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import sentencepiece_codec as C
from larkspur.llm import token_counts as T
from larkspur.llm.catalogue import QUERIES, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
JSON = tokenizer_path("byte_bpe_50k.json")
TEXT = st.lists(st.sampled_from(["a", "t", "e", " ", "  ", "\n", "▁", "é", "日", "\U0001f642", "\x00", "the", " the", "12", "ll", "\t", "<s>", "<0x41>", "'s", "<|endoftext|>", "ing", "-"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encode_and_decode_equal_the_library(text):
    model = C.load_model(PATH)
    ids = LIBRARY.encode(text)
    assert model.encode(text) == ids
    assert (model.decode(ids) if ids else "") == LIBRARY.decode(ids)


def test_repeats_and_long_words():
    model = C.load_model(PATH)
    for text in ("te" * 3000, "t" * 1001, "etet" * 500 + "e", "abcabcab" * 300, " " * 37 + "x", "x" + " " * 9, "ab" * 40 + "▁" + "ba" * 40):
        assert model.encode(text) == LIBRARY.encode(text)


def test_words_of_many_texts_merge_together():
    model = C.load_model(PATH)
    words = [" hello", " world", "tete", "日本", "", " the"]
    assert model.encode_words(words) == [model.encode_words([w])[0] for w in words]


def test_query_on_whole_texts(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(C, "CACHE_WORDS", 5)
    apply = C._digest_kernel(PATH, True)()
    for text in ("a b c d e f g h", "h g f e", "z y x w v u", ""):
        assert list(apply([text])["ids"][0]) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 30))
def test_cutting_keeps_counts(text, size):
    whole = Tokenizer.from_file(JSON)
    pieces = T.cut(text, size)
    assert "".join(pieces) == text
    assert sum(len(e) for e in whole.encode_batch(pieces, add_special_tokens=False)) == len(whole.encode(text, add_special_tokens=False))


def test_counts_equal_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = Tokenizer.from_file(JSON)
    for r in QUERIES["op10_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 512)


def test_other_files():
    assert T.Counter(PATH).count(["hello world", ""]) == [len(LIBRARY.encode("hello world")), 0]
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = "Hello  THERE world " * 3000
    counter = T.Counter(tokenizer_path("word_bpe_49k.json"))
    assert not counter.cuts and counter.count([text]) == [len(words.encode(text, add_special_tokens=False))]
