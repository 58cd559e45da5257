import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laborlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(open(PATH, encoding="utf-8").read())


def ids(own, text):
    return list(array("I", own.encode(text)))


def same(own, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert own.both(text) == (len(want), array("I", want).tobytes(), LIBRARY.decode(want, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, text):
    same(own, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstlu'dm ", max_size=80))
def test_many_merges(own, text):
    same(own, text)


def test_odd_texts(own):
    for t in ("", "   ", "ΑΣ ΣΑΣ İI ǅ", "é ﬁ Å", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's I'll DON'T", "a\x1cb\x85c d", "x" * 3000, "🙂👍🏽 12 345", "e<|endoftext|>́"):
        same(own, t)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in bpe.tokenized(docs, PATH).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = LIBRARY.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, bytes(g.ids)) == (len(want), array("I", want).tobytes())
        assert g.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, "hi"), (None, "hi")], "doc_id bigint, text string").selectExpr("*", "5 as ids")
    assert sorted(r.n_tokens for r in bpe.tokenized(df, PATH).collect()) == [0, 1, 1]
    assert bpe.tokenized(df.limit(0), PATH).count() == 0
