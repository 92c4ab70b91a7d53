import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from symgraph.llm import bag_minhash
from symgraph.llm.bag_minhash import PARITY, bag_signatures, band_keys, components, near_duplicates, overlap, possible
from symgraph.llm.wordhash import multiset, shingles, words


def shingle_bag(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, threshold=0.8):
    bags = [shingle_bag(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            least, most = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if bags[i] == bags[j] or least >= threshold * most:
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return sorted(((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str)


def variants(rng, n_bases=12):
    """Chains of edits, so classes hold texts that are not linked to each other, and near misses."""
    docs = []
    for _ in range(n_bases):
        base = [f"w{k}" for k in rng.integers(0, 400, int(rng.integers(30, 150)))]
        for _ in range(int(rng.integers(1, 9))):
            docs.append(" ".join(base))
            base = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 4))):
                base[at] = f"x{rng.integers(0, 1000)}"
    return docs


def test_signature_estimates_weighted_jaccard_without_bias():
    rng, errors = np.random.default_rng(0), []
    for i in range(25):
        a = [str(z) for z in rng.integers(0, 8, 300)]
        h, o, c = multiset(*shingles([" ".join(a), " ".join(a[: 100 + 8 * i] + [str(z) for z in rng.integers(0, 8, 200 - 8 * i)])]))
        s = bag_signatures(h, o, c, 2, 2000)
        errors.append((s[0] == s[1]).mean() - overlap((h[o == 0], c[o == 0]), (h[o == 1], c[o == 1])))
    assert abs(np.mean(errors)) < 0.008 and np.abs(errors).max() < 0.06


def test_words_and_shingles():
    texts = ["a b  c\td\x0be f", "", "é x", " \n ", "a b c d e"]
    hashes, bounds, data, starts, ends = words(texts)
    split = [[data[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(bounds[:-1], bounds[1:])]
    assert split == [["a", "b", "c", "d", "e", "f"], [], ["é", "x"], [], ["a", "b", "c", "d", "e"]]
    found, owner = shingles(texts)
    assert np.bincount(owner, minlength=5).tolist() == [2, 0, 1, 0, 1]
    assert found[owner == 4][0] == found[owner == 0][0]


def test_chunks_do_not_change_keys(monkeypatch):
    texts = [*variants(np.random.default_rng(5), 3), "", "one", "z " * 3000]
    whole = band_keys(texts)
    monkeypatch.setattr(bag_minhash, "CHUNK", 100)
    assert all((a == b).all() for x, y in zip(whole, band_keys(texts)) for a, b in zip(x, y))


def test_classes_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = list(enumerate([*variants(rng), "", None, " \t", "a b", "a  b", "a b c d", "u v w x y", "u v w x y"]))
    docs += [(None, "u v w x y"), (None, "only null"), (3, docs[3][1]), (700, "k " * 2000), (701, "k " * 1900)]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, digest string, class_id int")
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_docs) for r in got), key=str) == brute(docs)


def test_no_link_is_lost_when_the_hub_is_a_stranger(spark):
    """One bucket for all texts, like or not: the second step still finds all links there."""
    rng = np.random.default_rng(2)
    docs = list(enumerate(variants(rng, 8)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same_bucket = F.array(F.lit(7).cast("long"))
    signed = bag_minhash._signed
    try:
        bag_minhash._signed = lambda *a: signed(*a).withColumn("keys", same_bucket)  # every text has the one key 7
        got = near_duplicates(df).collect()
    finally:
        bag_minhash._signed = signed
    assert sorted(((r.doc_id, r.class_id, r.n_docs) for r in got), key=str) == brute(docs)


def test_parities_pass_every_link_and_stop_most_others(spark):
    rng = np.random.default_rng(7)
    texts = [*variants(rng, 6), "a a a a a a a a", "a " * 3000, "a " * 2500, "one", ""]
    bags = [shingle_bag(t) for t in texts]
    traits = [(i, int(t), *p.tolist()) for i, (_, _, p, t) in enumerate(band_keys(texts))]
    x, y = (spark.createDataFrame(traits, f"{c} int, total_{c} long, " + ", ".join(f"parity{i}_{c} long" for i in range(PARITY))) for c in "xy")
    passed = {(r.x, r.y) for r in x.join(y, F.col("x") < F.col("y")).filter(possible("x", "y", 0.8)).collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if bags[i] and bags[j]]
    share = {(i, j): sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values()) for i, j in pairs}
    assert {p for p in pairs if share[p] >= 0.8} <= passed
    assert sum(share[p] < 0.7 for p in passed if p in share) <= 0.02 * len(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    expected = {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert {r.node: r.label for r in rows} == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
