import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import winnowing
from symgraph.llm.winnowing import as_string, edited, fingerprint_edits, fingerprints, likeness

DOCS = [(5, "b" * 300), (None, "null id"), (1, None), (2, ""), (3, "short"), (9, "the quick brown fox " * 30), (9, "another text with id nine"), (7, "ünïcode 中文 😀" * 20), (8, "x" * 40)]


def brute(text, k, w):
    """Hash of every gram by itself, then the rightmost minimum of every window."""
    if not text:
        return []
    if len(text) < k:
        return [(int(fingerprints([text], k, w)[0][0][0]), 0)]
    grams = [int(fingerprints([text[i : i + k]], k, w)[0][0][0]) for i in range(len(text) - k + 1)]
    found = set()
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        low = min(window)
        found.add((low, i + max(j for j, h in enumerate(window) if h == low)))
    return sorted(found, key=lambda x: x[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=40), max_size=6))
def test_same_as_brute_force(texts):
    for text, (hashes, at) in zip(texts, fingerprints(texts, 4, 5)):
        assert list(zip(hashes.tolist(), at.tolist())) == brute(text, 4, 5)


def test_long_texts_in_pieces(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 3000))
    whole = as_string(fingerprints([text])[0])
    monkeypatch.setattr(winnowing, "PIECE", 500)
    assert as_string(fingerprints([text])[0]) == whole


def test_match_guarantee():
    rng = np.random.default_rng(2)
    make = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    shared = make(winnowing.GRAM + winnowing.WINDOW - 1)
    for _ in range(20):
        a, b = fingerprints([make(200) + shared + make(100), make(77) + shared])
        assert len(np.intersect1d(a[0], b[0])) >= 1


def test_short_texts_share_their_half_with_the_edited_copy():
    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    for n in range(42, 190):
        text = make(n)
        a, b = (np.unique(x[0]) for x in fingerprints([text, edited(text, make(300))]))
        assert likeness(a, b) > 0, n


def test_edge_cases(spark):
    df = spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, part string, tie int")
    rows = fingerprint_edits(df).collect()
    assert len(rows) == len(DOCS)
    got = {(r.doc_id, r.n_chars): r for r in rows}
    order = sorted([(d if d is not None else -1, t or "") for d, t in DOCS if d != 9])
    for (doc_id, text), (_, following) in zip(order[:-1], order[1:]):  # up to id 8, whose next is one with id 9
        r, e = got[None if doc_id < 0 else doc_id, len(text)], edited(text, following)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (np.unique(x[0]) for x in fingerprints([text, e, following]))
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(as_string, fingerprints([text, e])))
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
    assert fingerprint_edits(df.limit(0)).count() == 0


def test_query_pairs_every_document_with_the_next(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in winnowing.op9_winnowing(spark, sf).collect()}
    assert len(got) == len(docs)
    for (doc_id, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
