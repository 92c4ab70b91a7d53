import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symgraph.llm.common import new_folder
from symgraph.llm.records import frame, op10_record_files, parse, read_records, unframe, write_records


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_frames_show_damage():
    data = frame(b"one") + frame(b"") + frame(b"three" * 100)
    first, at = unframe(data, 0)
    second, at = unframe(data, at)
    assert (first, second, unframe(data, at)[0]) == (b"one", b"", b"three" * 100)
    for i in range(len(frame(b"one"))):
        with pytest.raises(Exception):
            unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], 0)
    assert parse(bytes([1, 0, 0, 0, 0, 0, 0, 0, 1, 2, 5, 0]))[0] is None


def test_edge_cases_and_shuffled_reads(spark, library):
    docs = [(3, "Three it's"), (None, "none"), (1, None), (2, ""), (2, "again"), (9, "wörd ½ 中文 <|endoftext|> " * 500)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, part string")
    manifest = write_records(df, new_folder(spark, "t"))
    rows = sorted(read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 9]
    expected = sorted([*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in docs)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == expected
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    shuffled = read_records(manifest, shuffle_seed=3).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, rows))
    assert read_records(write_records(df.limit(0), new_folder(spark, "t"))).count() == 0


def test_query(spark, library):
    sf, at = "/root/testdata/sf0.001", 0
    got = {r.doc_id: r for r in op10_record_files(spark, sf).collect()}
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_ids_that_are_no_integers_are_refused_and_large_parts_are_split(spark, monkeypatch):
    import pytest

    from symgraph.llm import ordered

    with pytest.raises(TypeError, match="integers"):
        ordered.id_ranges(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    monkeypatch.setattr(ordered, "ROWS", 10)
    rows, borders = ordered.id_ranges(spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string"))
    assert len(borders) == 20 and rows.groupBy("part").count().agg({"count": "max"}).first()[0] <= 20


def test_very_long_texts(spark, library):
    """A record of some megabytes; reading by blocks and one by one give the same."""
    docs = [(i, "word " * i) for i in range(300)] + [(1000, "Très long ½ " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    manifest = write_records(df, new_folder(spark, "t"))
    rows = {r.doc_id: r for r in read_records(manifest).collect()}
    assert len(rows) == 301 and len(rows[1000].ids) // 4 == len(library.encode(docs[-1][1], add_special_tokens=False).ids) + 1
    assert {r.doc_id: (r.start, r.ids) for r in read_records(manifest, shuffle_seed=1).collect()} == {k: (r.start, r.ids) for k, r in rows.items()}
