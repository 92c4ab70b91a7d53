import hashlib
import re

import pytest

from symgraph.llm.common import new_folder
from symgraph.llm.exact_dedup import dedup

DOCS = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, "x"), (5, None), (6, ""), (7, " \t\n"), (8, "y" * 5000), (8, "y" * 5000), (None, "x"), (10, "x "), (11, "a b  c")]


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for norm, rows in groups.items():
        best = min(rows, key=lambda r: (r[0], r[1], r[2] or 0))[2]
        out += [(i, best, len(rows), hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize(("files", "per_batch", "digest_chars"), [(1, 1024, 64), (3, 1, 64), (2, 1, 1), (2, 1024, 0)])
def test_same_as_brute_force(spark, files, per_batch, digest_chars):
    """Also over several micro-batches, and with digests so short that only the bytes tell texts apart."""
    path = new_folder(spark, "docs")
    spark.createDataFrame([(*d, "c", 1) for d in DOCS], "doc_id long, text string, digest string, n int").repartition(files).write.parquet(path)
    rows = dedup(spark, path, files_per_batch=per_batch, digest_chars=digest_chars).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute(DOCS)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_empty_table(spark):
    path = new_folder(spark, "docs")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert dedup(spark, path).count() == 0
