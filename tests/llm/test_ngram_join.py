import itertools
import random
import re

import numpy as np
import pytest

from symgraph.llm.ngram_join import entries, head_size, jaccard_components, op12_ngram_join, overlap_needed, parts_of, token_sets


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs, percent=80):
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least.setdefault(root(i), []).append(doc_id)
    low = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [(32, 1024), (1, 3), (0, 0), (2, 2)])
def test_links_share_an_entry(limits):
    """Random sets with a given overlap, tokens of all classes: no link without a common entry, for any sizes."""
    rng = random.Random(7)
    for trial in range(400):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33, 60, 64, 70, 130, 300])
        universe = [rng.getrandbits(64) for _ in range(2 * n + 4)]
        counts = {t: rng.choice([2, 2, 3, 5, 40, 2000]) for t in universe}
        x = universe[:n]
        y = list(x)
        for _ in range(rng.randint(0, max(1, n // 4))):  # some tokens go, some come
            if rng.random() < 0.5 and len(y) > 1:
                y.remove(rng.choice(y))
            else:
                y.append(rng.choice([t for t in universe if t not in y]))
        both = len(set(x) & set(y))
        if 100 * both < 80 * len(set(x) | set(y)):
            continue
        own = lambda s: entries(len(s), np.array(sorted(s), np.uint64), np.array([counts[t] for t in sorted(s)]), 80, limits)
        assert set(own(x).tolist()) & set(own(y).tolist())
        heads = [set(sorted(s)[: head_size(len(s))]) for s in (x, y)]
        for s, h in zip((x, y), heads):
            assert len(heads[0] & heads[1]) >= max(1, -(-overlap_needed(len(s)) // 20))


def test_tokens_of_one_text_only_need_no_entry():
    tokens = np.arange(80, dtype=np.uint64)
    assert len(entries(101, tokens, np.full(80, 2))) == 0
    assert len(entries(100, tokens, np.full(80, 2))) == 1
    assert [parts_of(b) for b in range(6)] == [0, 0, 1, 1, 1, 2]


def test_sets_of_texts():
    tokens, bounds = token_sets([b"", b"one two", b"a b c d e f a b c d e", b"x"])
    assert np.diff(bounds).tolist() == [0, 1, 6, 1] and all((np.diff(tokens[a:b].astype(object)) > 0).all() for a, b in zip(bounds, bounds[1:]) if b > a)


def near_copies(seed=3):
    rng, docs = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 12, 40, 150]))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 9])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                edited[rng.randrange(len(edited))] = word()
            docs.append(" ".join(edited))
    docs += [" ".join([word() for _ in range(rng.choice([10, 15, 20]))] + passage) for _ in range(30)]
    return docs


EDGE = ["", None, " \n", "", "one", "One", "one  two", "a b c d e", "A b c D e", "a b c d e f", "x x x x x x", "x x x x x x x x", "É b c d e", "é b c d e", "Long Text " * 30_000, "long text " * 29_000]


@pytest.mark.parametrize("limits", [(32, 1024), (2, 6), (0, 3)])
def test_same_as_brute_force(spark, limits):
    """Edge cases, near copies in groups, a passage many texts share; with limits so low that combinations are used."""
    docs = list(enumerate(EDGE + near_copies()))
    docs += [(7, docs[7][1]), (7, "another text of that id is here"), (None, EDGE[7]), (None, "alone with no id at all")]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, rep int").repartition(3)
    assert got(jaccard_components(df, limits=limits)) == brute(docs)


def test_empty_table_text_ids_and_full_filter(spark):
    schema = "`a.b` string, `t.x` string"
    assert jaccard_components(spark.createDataFrame([], schema), "a.b", "t.x").count() == 0
    docs = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None)]
    assert got(jaccard_components(spark.createDataFrame(docs, schema), "a.b", "t.x")) == [("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")]
    more = list(enumerate(near_copies(5)))
    assert got(jaccard_components(spark.createDataFrame(more, "doc_id long, text string"), filter_bits=64)) == brute(more)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(op12_ngram_join(spark, "/root/testdata/sf0.001")) == brute(docs)
