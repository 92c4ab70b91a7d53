import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from symgraph.llm.wordbpe import _STOP, Vocabulary, WordEncoder, op3_speculative_bpe

TEXTS = ["It's A test, WE'LL see 42 ½ x²", "", None, "a<|endoftext|>b <|x|>", "ΣΊΣΥΦΟΣ İstanbul \xe9 ́x 中文 \U0001f642\U0001f642", "\x1c\x85　 z", "ab" * 4000, "-----===", "aaa aaaa aaaaaaaa", "</w> x</w>"]


@pytest.fixture(scope="module")
def own():
    return Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(own, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(own.encode_words, own.encode_chunks)(texts)]


def test_same_as_library(own, library):
    assert encoded(own, TEXTS) == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(alphabet="abehilnorst' -.ABÉéß1²", max_size=40), st.text(max_size=20)))
def test_same_as_library_on_any_text(own, library, text):
    assert encoded(own, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_proposals_are_verified(own):
    """A proposal that differs from the exact merges always has a failing pair, and some do differ."""
    words = sorted({a + b + c for a in ("er", "th", "nd", "ble", "you") for b in ("on", "in", "ion", "ha") for c in ("ly", "st", "ing", "ea")})
    wrong = 0
    for w in words:
        proposed, exact = own.propose(w + _STOP), own.merge_exactly(w + _STOP)
        ids = np.array(proposed)
        assert (proposed == exact) == bool(own.compatible(ids[:-1], ids[1:]).all())
        wrong += proposed != exact
    assert 0 < wrong < len(words)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op3_speculative_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_in_slices_and_decode_column(spark, library):
    from pyspark.sql import functions as F

    from symgraph.llm import wordbpe

    docs = [*enumerate(TEXTS), (None, "null id"), (3, "word " * 300_000)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in wordbpe.round_trip(df).collect())
    assert got == sorted((str(r.doc_id), bytes(r.ids), r.d) for r in wordbpe.encode(df).withColumn("d", wordbpe.decode(F.col("ids"))).collect())
    assert sorted(np.frombuffer(x[1], "<u4").tolist() for x in got) == sorted(library.encode(t or "", add_special_tokens=False).ids for _, t in docs)
    assert wordbpe.round_trip(df.limit(0)).count() == 0
