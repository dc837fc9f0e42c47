import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pieces import MODEL, encode, op8_sentencepiece, table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


PARTS = ["  ", "▁", " ", "a", "th", "e", "\n", "\t", "é", "😀", "①", "the", "ing", "\r", "(", "aa", ",", "1", "00", "\x00", "return ", " " * 9, "<s>", "<0x41>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=20).map("".join))
def test_ids_and_text_are_the_librarys(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    ids = table().encode(text)
    assert ids == sp.encode(text, add_bos=True, add_eos=True) and table().decode(ids) == sp.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=8))
def test_any_ids_decode_as_the_librarys(ids):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    assert table().decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + " " * 500, "abcdefgh" * 900 + "\n" + "▁" * 40, "lorem, ipsum. " * 500])
def test_long_texts(library, text):
    assert table().encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_odd_rows(odd, empty, library):
    rows = encode(odd, keep=("source",)).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and encode(empty).isEmpty()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text, add_bos=True, add_eos=True) and r["decoded"] == library.decode(r["ids"])


def test_kept_columns_may_have_any_name(odd, library):
    kept = tuple(dict.fromkeys(c for c in odd.columns if c != "doc_id"))
    rows = encode(odd, keep=kept)
    taken = {"ids": "kept_ids", "decoded": "kept_decoded"}
    assert rows.columns == ["doc_id", *[taken.get(c, c) for c in kept], "ids", "decoded"]
    for r in rows.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True) and r["kept_ids"] == [1]
        assert r["a.b`c"] == 1 and r["_text"] == "mine _text"
    renamed = odd.withColumnRenamed("doc_id", "number").selectExpr("*", "'x' doc_id")
    assert encode(renamed, id_col="number", keep=("doc_id", "doc_id")).columns == ["doc_id", "kept_doc_id", "ids", "decoded"]


def test_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op8_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
