import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symgraph.llm import packing
from symgraph.llm.packing import Bins, ByteBPE, op1_harmonic_packing, pack

TEXTS = ["a plain text, it's short", "", None, "x  y \n\n z  ", "word " * 3000, "<|endoftext|> in <|endoftext|>", "Größe é 12½ \x85　 中文\x1c!", "a", "a"]
FILE = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    return Tokenizer.from_file(FILE)


@lru_cache
def expected(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


@lru_cache
def encoder():
    return ByteBPE(FILE)


def check(rows, texts, tasks):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = np.array(expected(texts[doc_id]), "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        short += at < 1024
    assert short <= tasks  # each task pads its last sequence at most


def test_pack_edge_cases(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(2)
    check(pack(df).withColumn("ids_crc32", F.crc32("ids")).collect(), dict(enumerate(TEXTS)), 2)
    assert pack(df.limit(0)).count() == 0


def test_null_repeated_and_text_ids(spark):
    df = spark.createDataFrame([(None, "one"), ("x", "two"), ("x", "two"), ("y", None)], "doc_id string, text string").coalesce(1)
    out = pack(df).collect()
    assert sorted((r.doc_id or "", r.length) for r in out) == [("", 2), ("x", 2), ("x", 2), ("y", 1)]
    assert sum(r.length for r in out) == 7
    assert len({r.sequence_id for r in out}) == 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x1c\x85'’sdt½²_09aé ")), max_size=60))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(encoder()(text), "<u4").tolist() == expected(text)[:-1]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    own = ByteBPE(FILE)
    for i in range(50):
        assert np.frombuffer(own(f"word{i} again"), "<u4").tolist() == expected(f"word{i} again")[:-1]
    assert own.size <= 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.sampled_from([1, 7, 64]))
def test_bins_keep_every_token(lengths, capacity):
    bins, rows, at, docs = Bins(capacity, 5), [], 0, []
    for i, n in enumerate(lengths):
        docs.append(np.arange(at, at + n, dtype="<u4").tobytes())
        rows += bins.add(i, docs[-1])
        at += n
        assert all(len(w) < k for k, w in bins.waiting.items()) and bins.stocked < 2 * capacity
    rows += bins.rest()
    pieces = {}
    filled = {}
    for doc, start, length, total, ids, sequence, offset in rows:
        assert len(ids) == 4 * length and total == lengths[doc]
        pieces.setdefault(doc, []).append((start, ids))
        filled.setdefault(sequence, []).append((offset, length))
    assert [b"".join(ids for _, ids in sorted(pieces[i])) for i in range(len(lengths))] == docs
    sizes = [sum(n for _, n in sorted(found)) for _, found in sorted(filled.items())]
    assert all(n == capacity for n in sizes[:-1])


def test_full_bins_hold_whole_pieces_of_one_class():
    bins, rng = Bins(1024, 0), np.random.default_rng(3)
    for i in range(3000):
        n = int(rng.integers(1, 1500))
        closed = bins.add(i, bytes(4 * n))
        for sequence in {r[5] for r in closed}:
            inside = [r for r in closed if r[5] == sequence]
            k = 1024 // inside[0][2]
            assert all(1024 // r[2] == k for r in inside[:k]) and [r[1] % 1024 for r in inside[:k]] == [0] * k


@pytest.mark.parametrize("partitions", [1, 3])
def test_query_on_small_table(spark, partitions):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(pack(docs.repartition(partitions)).withColumn("ids_crc32", F.crc32("ids")).collect(), texts, partitions)
    if partitions == 1:
        out = op1_harmonic_packing(spark, sf).collect()
        check(out, texts, docs.rdd.getNumPartitions())
