import re

import corpus_pipeline
from symgraph.llm.common import written

from .test_bag_minhash import brute as near_brute
from .test_exact_dedup import brute as exact_brute
from .test_packing import check

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), f"test-{name}")
        made[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
            assert all(before[r.doc_id] == r for r in made[name][1])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, wanted in (("quality", lambda x: x.quality == 1), ("toxicity", lambda x: x.toxic == 0)):
        before, after = made[name]
        left = {r.doc_id for r in after}
        right = [(i in left) == wanted(labels[i]) for i in before if i in labels]
        assert sum(right) / len(right) > 0.95
    before, after = made["exact_dedup"]
    assert {r.doc_id for r in after} == {best for _, best, _, _ in exact_brute([(i, r.text) for i, r in before.items()])}
    before, after = made["near_dedup"]
    assert {r.doc_id for r in after} == {c for _, c, _ in near_brute(sorted((i, r.text) for i, r in before.items()))}
    before, after = made["packing"]
    check(after, {i: r.text for i, r in before.items()}, 8)


LONG = "many words that repeat and go on " * 3000
ODD = [
    (1, None, None, None, None, "e", 1, None, "m"), (1, None, None, None, None, "f", 2, None, "m"), (2, "", "en", "s", 0, "e", 3, "q", "m"), (None, "x y z", "en", "s", 5, None, 4, "q", "m"),
    (4, LONG, "en", "s", 150000, "e", 5, "q", "m"), (None, LONG + "end", "en", "s", 150003, "e", 6, "q", "m"), (None, LONG + "here", "en", "s", 150004, "e", 7, "q", "m"), (4, "other words", "en", "s", 11, "e", 8, "q", "m"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, locator string, place int, `Quality_Score` string, `_metadata` string"


def test_odd_rows_and_columns(spark):
    """Null and repeated ids, empty and long texts, columns with the operators' own names: values, stage by stage."""
    docs = spark.createDataFrame(ODD, COLUMNS)
    labels = {n: [] for n in ("quality", "toxicity")}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = written(stage(spark, docs, SF), f"odd-{name}")
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(set(rows)) and set(rows) <= set(ODD)
        if name in labels:
            assert len(rows) > 0 or name == "quality"
            continue  # what goes is the model's decision: the next stage gets all rows
        texts = [re.sub(r"\s", "", r[1] or "") for r in rows]
        if name == "exact_dedup":
            assert sorted(texts) == sorted({re.sub(r"\s", "", r[1] or "") for r in ODD})
            assert not any(r[6] in (2, 3) for r in rows)  # of the empty texts a row of the least id stays
        else:
            assert sorted(r[6] for r in rows) in ([1, 4, 5, 8], [2, 4, 5, 8])  # of the long ones the row with an id
    assert corpus_pipeline.pack(spark, docs, SF).agg({"length": "sum"}).first()[0] > 40_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two  three four five six"), (None, "seven")], "doc_id string, text string")
    for stage, kept in ((corpus_pipeline.exact, ["a", None]), (corpus_pipeline.near, ["a", None])):
        assert sorted((r.doc_id for r in stage(spark, docs, SF).collect()), key=str) == sorted(kept, key=str)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
