import pytest
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from symgraph.llm import gated_lm, lm_scoring
from symgraph.llm.gated_lm import GatedLM
from symgraph.llm.lm_scoring import op6_gated_lm


def plain_score(model, doc):
    """One token after the other, with full softmaxes."""
    h, last, total = np.zeros((1, model.h)), 0, 0.0
    for y in doc:
        h, _ = model.step(h, np.array([last]))
        c, k = divmod(int(y), model.size)
        for logits, i in ((h @ model.p["Wc"] + model.p["bc"], c), (h @ model.p["Wo"][c] + model.p["bo"][c], k)):
            total += float(logits[0, i] - np.log(np.exp(logits).sum()))
        last = y
    return total


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    model = GatedLM(rng.integers(1, 50, 11).astype(float), hidden=5, dtype=np.float64)
    for k in ("Wc", "Wo"):
        model.p[k] += rng.normal(0, 0.5, model.p[k].shape)
    return model


def test_gradients_are_right():
    model, rng = random_model(), np.random.default_rng(2)
    x, y, h = rng.integers(0, 11, (3, 6)), rng.integers(0, 11, (3, 6)), rng.normal(0, 1, (3, 5))
    fresh = (x == 0).astype(float)
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    model.window(h, x, y, fresh, grads)
    waste = lambda: {k: np.zeros_like(v) for k, v in model.p.items()}
    for k, v in model.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in v.shape)
            if v[i] < -1e8:
                continue
            old, ends = v[i], []
            for d in (1e-5, -1e-5):
                v[i] = old + d
                ends.append(-model.window(h, x, y, fresh, waste())[0])
            v[i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-4, (k, i)


def test_state_is_carried_over_windows_and_documents_do_not_touch():
    model, rng = random_model(), np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 11, n), 0) for n in (0, 1, 300, 7, 64, 63, 65, 2, 150)]
    got = model.log_likelihood(docs, slots=3, steps=16)
    assert np.allclose(got, [plain_score(model, d) for d in docs])


def test_training_learns_what_follows_what():
    docs = [np.array([1, 2, 3] * 30 + [0])] * 40 + [np.array([4, 5, 6] * 30 + [0])] * 40
    counts = np.bincount(np.concatenate(docs), minlength=9).astype(float)
    model = GatedLM(counts, hidden=16)
    before = model.log_likelihood(docs[:1])[0]
    model.train(docs, epochs=6, streams=16)
    assert model.log_likelihood(docs[:1])[0] > before * 0.3


def test_training_reads_every_token(monkeypatch):
    model, read = random_model(), []
    monkeypatch.setattr(model, "window", lambda h, x, y, fresh, grads, f=model.window: (read.append((x, y)), f(h, x, y, fresh, grads))[1])
    doc = np.append(np.random.default_rng(4).integers(1, 11, 1006), 0)
    model.train([doc], streams=9)
    pairs = Counter((a, b) for x, y in read for a, b in zip(x.ravel().tolist(), y.ravel().tolist()))
    assert pairs == Counter(zip([0, *doc[:-1].tolist()], doc.tolist()))


def test_every_training_document_is_read_once(spark, tmp_path, monkeypatch):
    path, read = f"file://{tmp_path}", []
    docs = [(i, "a b " * (i % 5) + f"w{i}") for i in range(3000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(lm_scoring, "COPY", 2000)  # several copies a round
    monkeypatch.setattr(lm_scoring, "train_round", lambda *a, f=lm_scoring.train_round: read.append(f(*a)))
    rows = op6_gated_lm(spark, path).collect()
    assert len(read) == len(lm_scoring.RATES)
    assert sum(read) == rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)


def test_vocabulary_and_groups_grow_with_the_counted_words(spark):
    sizes = []
    for n in (300_000, 1_200_000):
        counts = spark.range(n).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.when(F.col("id") < 10_000, 10_000 - F.col("id")).otherwise(1).cast("long").alias("c"))
        scorer = lm_scoring.learn(counts, spark.createDataFrame([], "id long, text string"))
        sizes.append((scorer.first_group - 1, scorer.groups, len(scorer.known)))
    assert sizes == [(2190, 136, 9999), (4381, 273, 9999)]


def test_equally_frequent_words_are_known_all_or_none(spark):
    counts = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([9, 7, 7, 7, 3, 1, 1])], "word string, c long")
    assert [lm_scoring.least_count(counts, n) for n in (0, 1, 3, 4, 5, 6, 7)] == [1 << 62, 9, 9, 7, 3, 3, 1]
    large = spark.range(1, 3000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), (F.col("id") * F.col("id") * F.col("id")).alias("c"))
    for n in (1, 10, 500, 2900):
        taken = large.filter(F.col("c") >= lm_scoring.least_count(large, n)).count()
        assert 0.7 * n - 1 <= taken <= n
    assert lm_scoring.least_count(counts.limit(0), 5) == 1 << 62


def test_shares_sum_to_one():
    words, counts = [f"w{i}" for i in range(50)], np.arange(100, 50, -1).astype(float)
    totals = np.zeros((4, 2))
    for w, c in zip(words[20:], counts[20:]):
        totals[lm_scoring.group_of(w, 4)] += (c, 1)
    scorer = lm_scoring.Scorer(words, counts, 20, totals, int(counts.sum()) + 7, 51, 7)
    rng = np.random.default_rng(5)
    for k in ("Wc", "Wo"):
        scorer.model.p[k] += rng.normal(0, 0.5, scorer.model.p[k].shape).astype(np.float32)
    h = rng.normal(0, 1, (1, scorer.model.h)).astype(np.float32)
    token = np.exp([scorer.model.outputs(h, np.array([y]))[0][0] for y in range(scorer.model.v)])
    assert math.isclose(token.sum(), 1, rel_tol=1e-5)
    shares = np.zeros(4)
    for w, c in zip(words[20:], counts[20:]):
        g = lm_scoring.group_of(w, 4)
        shares[g] += (c + 0.5) / 10 ** scorer.group[g]
    assert np.allclose(shares + 0.5 / 10**scorer.group, 1)  # the last 0.5 is for unseen words


def brute(docs):
    split = {i: [*(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w), "\n"] for i, t in docs}
    c = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in split.items()}


def brute_score(scorer, counts, text):
    """The model word by word, a group's probability shared out by count."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    ids, logs = [], 0.0
    for w in words:
        at = scorer.known.get(w.encode())
        if at is not None and at < scorer.first_group - 1:
            ids.append(at + 1)
        else:
            g = lm_scoring.group_of(w, scorer.groups)
            ids.append(scorer.first_group + g)
            logs += math.log10(counts[w] + 0.5) - scorer.group[g]
    return plain_score(scorer.model, [*ids, 0]) / math.log(10) + logs


def test_query_against_brute_force(spark, monkeypatch):
    sf, learned = "/root/testdata/sf0.001", []
    monkeypatch.setattr(lm_scoring, "learn", lambda *a, f=lm_scoring.learn: (learned.append(f(*a, known=3000)), learned[0])[1])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows, expected = op6_gated_lm(spark, sf).collect(), brute(docs)
    counts, texts = Counter(), dict(docs)
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split())
    for r in [r for r in rows if len(texts[r.doc_id] or "") < 3000][:25]:
        assert math.isclose(r.score, brute_score(learned[0], counts, texts[r.doc_id]), rel_tol=1e-4)
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = [(0, None), (1, "A b"), (2, "\x0b"), (3, "É é " * 3000), (3, "É é " * 3000)]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, row int").write.parquet(f"{path}/documents.parquet")
    rows, expected = op6_gated_lm(spark, path).collect(), brute(docs[:4])
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, expected[i][0]) for i, _ in docs)
    assert all(math.isfinite(r.score) for r in rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/none/documents.parquet")
    assert op6_gated_lm(spark, f"{path}/none").count() == 0


@pytest.mark.parametrize("n", [1, 3, 64, 65, 200])
def test_copies_are_averaged_in_bounded_groups(spark, monkeypatch, n):
    """The weighted mean, by groups of at most MERGED copies, here 4 (64 stages by default)."""
    monkeypatch.setattr(lm_scoring, "MERGED", 4)
    rng = np.random.default_rng(n)
    weights, read = rng.normal(size=(n, 2, 5)).astype(np.float32), rng.integers(1, 100, n)
    rows = [(s, i, int(read[i]), weights[i, s].tobytes()) for i in range(n) for s in range(2)]
    got = lm_scoring.averaged(spark.createDataFrame(rows, lm_scoring.COPIES), n - 1)
    for r in got.collect():
        expected = (weights[:, r.slice] * read[:, None]).sum(axis=0) / read.sum()
        assert r["read"] == read.sum() and np.allclose(np.frombuffer(r.weights, np.float32), expected, atol=1e-5)
    parts, most = n, 0
    while parts > 1:
        before, parts = parts, -(-parts // 4)
        most = max(most, -(-before // parts))
    assert most <= 4 and got.count() == 2


def test_every_text_is_read_once(spark, tmp_path, monkeypatch):
    """One pass over the texts; counting, both rounds and scoring go on with its numbers."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def noted(i, text):
        with open(seen / str(i), "a") as f:
            f.write("x")
        return text

    docs = spark.createDataFrame([(i, f"a b w{i}") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(lm_scoring, "table", lambda *_: docs.withColumn("text", F.udf(noted, "string")("doc_id", "text")))
    assert op6_gated_lm(spark, "").count() == 60
    assert {f.name: f.read_text() for f in seen.iterdir()} == {str(i): "x" for i in range(60)}


def test_parts_of_texts_give_every_text_back(spark):
    """Several parts a round; words that are not known come with how often they occur."""
    texts = {i: " ".join(["a", "B"] * (i % 4) + [f"n{i}", "n"] * (i % 3)) for i in range(50)}
    scorer = lm_scoring.Scorer(["a", "b"], np.array([9.0, 5.0]), 1, np.array([[5.0, 1], [0, 0]]), 64, 3, 50)
    got, rounds = {}, Counter()
    for p in lm_scoring.read_once(spark.createDataFrame([(i, t, i % 5 == 0) for i, t in texts.items()], "id long, text string, held_out boolean").coalesce(1), most=40).collect():
        rounds[p["round"]] += 1
        docs = scorer.documents(p.words, p.codes, p.ends)
        for i, doc, row in zip(p.ids, docs, scorer.rows(p.words, p.codes, p.ends)):
            assert int(i) not in got and (int(i) % 5 == 0) == (p["round"] < 0) and doc.tolist() == row[0].tolist()
            got[int(i)] = row
    assert len(got) == 50 and set(rounds) == {-1, 0, 1} and min(rounds.values()) > 1
    group = lambda w: 2 + lm_scoring.group_of(w, 2)
    for i, t in texts.items():
        words = t.lower().split()
        ids, sums, outside, known, rest, often = got[i]
        assert ids.tolist() == [1 if w == "a" else group(w) for w in words] + [0]
        assert math.isclose(sums, sum({"a": math.log10(9.5), "b": math.log10(5.5)}.get(w, 0) for w in words), abs_tol=1e-12)
        assert math.isclose(outside, sum((w == "b") * math.log10(5.5) - scorer.group[group(w) - 2] for w in words if w != "a"), abs_tol=1e-12)
        assert known == sum(w in "ab" for w in words) and dict(zip(rest, often)) == Counter(w for w in words if w not in "ab")


@pytest.mark.parametrize("scale", [1, 400])
def test_blocks_and_large_weights_change_nothing(monkeypatch, scale):
    """Logits beyond what exponentials bear are shifted first; layers are worked on in blocks of rows."""
    model, rng = random_model(), np.random.default_rng(6)
    for k in ("Wc", "Wo"):
        model.p[k] *= scale
    docs = [np.append(rng.integers(1, 11, n), 0) for n in (90, 30, 5)]
    assert np.allclose(model.log_likelihood(docs, slots=2), [plain_score(model, d) for d in docs])
    h, y = rng.uniform(-1, 1, (200, 5)), rng.integers(0, 11, 200)
    whole = {k: np.zeros_like(v) for k, v in model.p.items()}
    parts = {k: np.zeros_like(v) for k, v in model.p.items()}
    out, back = model.outputs(h, y, whole)
    monkeypatch.setattr(gated_lm, "ROWS", 7)
    out_parts, back_parts = model.outputs(h, y, parts)
    assert np.isfinite(out).all() and np.allclose(out, out_parts) and np.allclose(back, back_parts)
    assert all(np.allclose(whole[k], parts[k]) for k in whole)
