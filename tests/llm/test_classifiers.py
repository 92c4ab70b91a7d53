import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from symgraph.llm import quality, toxicity
from symgraph.llm.linear import Rows, sigmoid

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in toxicity.op4_counterfactual_toxicity(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    hits = sum(p and y for p, y in held)
    assert hits / max(1, sum(p for p, _ in held)) > 0.8 and hits / sum(y for _, y in held) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())


def identity_sample():
    """Toxic sentences mention one group more often than neutral ones do: a biased sample."""
    out, rng = [], np.random.default_rng(0)
    for i in range(400):
        filler = " ".join(f"w{k}" for k in rng.integers(0, 200, 12))
        toxic = i % 2
        out.append((f"{filler} {'muslim' if rng.random() < (0.7 if toxic else 0.1) else 'christian'} {'idiot' if toxic and rng.random() < 0.7 else ''}", float(toxic)))
    return out


def test_counterfactual_penalty_lowers_false_positives(spark):
    sample = spark.createDataFrame(identity_sample(), "text string, y double")
    neutral = [f"the muslim family w{i} had dinner" for i in range(20)]
    other = [t.replace("muslim", "christian") for t in neutral]
    plain, fair = (toxicity.train(sample, fairness=f) for f in (0.0, 10.0))
    assert (toxicity.scores(neutral, plain) >= 0.5).all()
    gap = np.abs(toxicity.scores(neutral, fair) - toxicity.scores(other, fair))
    assert gap.max() < 0.2 * np.abs(toxicity.scores(neutral, plain) - toxicity.scores(other, plain)).max()
    assert (toxicity.scores(["that idiot w3 w4"], fair) > 0.5).all()


def test_swaps():
    assert toxicity.swaps("A Gay man, not gayish") == ["a lesbian woman, not gayish", "a bisexual man, not gayish"]
    assert toxicity.swaps("nothing here") == []


def test_swaps_in_other_languages_and_with_own_terms():
    assert toxicity.swaps("Une femme.") == ["une homme."]
    assert toxicity.swaps("Die Frauen") == ["die männer"]
    assert toxicity.swaps("el refugiado") == ["el ciudadano", "el inmigrante"]
    assert toxicity.swaps("kvinna, woman", (("kvinna", "man"),)) == ["man, woman"]
    assert toxicity.swaps("woman", ()) == []
    terms = [t for group in toxicity.IDENTITY for t in group]
    assert len(terms) == len(set(terms))


def test_number_of_swapped_pairs_is_logged(spark, caplog):
    caplog.set_level("INFO", logger=toxicity.__name__)
    rows = [(f"w{i % 2} {'une femme' if i < 10 else ''}", float(i % 2)) for i in range(40)]
    sample = spark.createDataFrame(rows, "text string, y double")
    toxicity.train(sample)
    toxicity.train(sample, identity=())
    assert [(r.levelname, r.getMessage()) for r in caplog.records if r.name == toxicity.__name__] == [("INFO", "10 swapped pairs, 30 inserted ones from 40 labelled texts"), ("WARNING", "0 swapped pairs, 0 inserted ones from 40 labelled texts")]


def test_mentions_inserted_into_labelled_texts_are_penalised(spark):
    """A term that comes with toxic labels loses its weight also where no text has two terms of a group."""
    rng, rows = np.random.default_rng(2), []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((f"{' '.join(f'w{k}' for k in rng.integers(0, 99, 9))} {'idiot' if toxic and i % 2 else ''} {'refugee' if toxic and i % 4 < 3 else ''}", float(toxic)))
    sample = spark.createDataFrame(rows, "text string, y double")
    group = (("refugee", "citizen"),)
    change = []
    for fairness in (0.0, 20.0):
        model = toxicity.train(sample, fairness, group)
        change.append(np.subtract(*toxicity.scores(["w1 w2 a refugee", "w1 w2 a"], model)))
    assert change[0] > 0.3 and abs(change[1]) < 0.2 * change[0]


def test_the_tables_give_pairs(spark, caplog):
    caplog.set_level("INFO", logger=toxicity.__name__)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxicity.learn(docs, labels)
    found = [r.args for r in caplog.records if r.name == toxicity.__name__]
    assert sum(found[0][:2]) >= found[0][2] > 100


def test_scores_look_at_sets_of_whole_texts(monkeypatch):
    kept, w = np.unique(toxicity.features(["bad worse idiots"])[0]), None
    w = np.arange(1, len(kept) + 1) / 3
    texts = ["bad bad", "", "x " * 5000 + "worse, idiots!", "Idiots."]
    expected = [sigmoid(np.array(Rows([np.searchsorted(kept, np.intersect1d(kept, toxicity.features([t])[0]))], len(kept)).times(w) - 1)[0]) for t in texts]
    assert np.allclose(toxicity.scores(texts, (kept, w, -1.0)), expected)
    monkeypatch.setattr(toxicity, "CHUNK", 1)
    assert np.allclose(toxicity.scores(texts, (kept, w, -1.0)), expected)


def test_toxicity_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "c"), (1, None, "c"), (None, "x", "c"), (3, "y " * 9000, "c")], "doc_id long, text string, y string")
    for labels in ([], [(1, 1)], [(1, 1), (3, 0), (None, 1), (7, None)]):
        score = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = [r.s for r in docs.select(score(F.col("text")).alias("s")).collect()]
        assert len(got) == 4 and all(0 <= s <= 1 for s in got) and got[0] == got[1]
    assert docs.limit(0).select(score(F.col("text"))).count() == 0


def learned(docs, labels):
    return quality.learn(quality.view_table(docs), labels)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = learned(docs, labels.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = quality.scored(docs, model).join(labels.filter("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").select("quality_score", "quality").collect()
    right = sum((r.quality_score >= quality.THRESHOLD) == (r.quality == 1) for r in held)
    assert right / len(held) > 0.93
    good = [r for r in held if r.quality == 1]
    assert sum(r.quality_score >= quality.THRESHOLD for r in good) / len(good) > 0.95


def plain_content(text):
    """The content view of one text, word by word and line by line."""
    data, n = text.encode(), len(text.encode())
    split = [w.encode() for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    k, lines = max(len(split), 1), data.split(b"\n")
    letters = lambda w: all(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w)
    filled = [tuple(re.split(rb"[\x20\x09-\x0d]+", x.strip(b" \t\x0b\x0c\r"))) for x in lines if x.strip(b" \t\x0b\x0c\r")]
    return [
        *(sum(b in c for b in data) / max(n, 1) for c in quality._CLASSES),
        len(text) / k, len(set(split)) / k, len(set(zip(split, split[1:], split[2:]))) / max(len(split) - 2, 1),
        sum(any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w) for w in split) / k,
        sum(not (48 <= w[-1] <= 57 or letters(w[-1:])) for w in split) / k, sum(not letters(w) for w in split) / k,
        len(set(filled)) / max(len(filled), 1), np.log1p(len(lines)), np.log1p((n + 1 - len(lines)) / len(lines)), np.log1p(max(map(len, lines))),
    ]


def test_content_view_against_plain_python(monkeypatch):
    texts = ["", "a", "A b, c!\nA b, c!\n\n x", "Größe ÄÖ 12 \x0b\t end", "one two three one two three one", "\n\n", "x\n" * 50 + "y z", "| $$ | A1 b2", " lead\n lead"]
    assert np.allclose(quality.content_view(texts), [plain_content(t) for t in texts])
    assert quality.content_view([]).shape == (0, len(plain_content("")))
    whole = quality._viewed(*(pd.Series(x) for x in (texts, ["en"] * 9, [None] * 9, [1.0] * 9)))
    monkeypatch.setattr(quality, "CHUNK", 1)
    pd.testing.assert_frame_equal(whole, quality._viewed(*(pd.Series(x) for x in (texts, ["en"] * 9, [None] * 9, [1.0] * 9))))


def test_quality_query_scores_each_document_by_the_model(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "learn", lambda *a, f=quality.learn: (kept.append(f(*a)), kept[0])[1])
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in quality.op5_co_training(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    model = kept[0]
    for d in docs:
        content = np.array([plain_content(d.text or "")], np.float32)
        number, categories = quality.metadata_view(d.lang, d.source, d.n_chars)
        logits = []
        for view, numbers, cats in zip(model.views, (content, np.array([[number]], np.float32)), ([], categories)):
            cells = [i * quality.BINS + int((e <= x).sum()) for i, (e, x) in enumerate(zip(view.edges, numbers[0]))] + [len(view.edges) * quality.BINS + c for c in cats]
            logits.append(np.clip((view.weights[cells].sum() + view.bias) * view.slope + view.shift, -12, 12))
        assert abs(rows[d.doc_id].quality_score - sigmoid(np.array(logits) @ model.mixing + model.shift)) < 1e-6
        assert rows[d.doc_id].good == (rows[d.doc_id].quality_score >= quality.THRESHOLD)


def synthetic(spark, n=3000):
    """A view_table with labels that both views show, the second one less clearly."""
    rng = np.random.default_rng(1)
    y = (rng.random(n) < 0.5).astype(float)
    content = rng.normal(0, 1, (n, quality.SHAPES[0][0]))
    content[:, 0] = y + rng.normal(0, 0.3, n)
    meta = y + rng.normal(0, 0.6, n)
    content, meta = content.astype(np.float32).astype(float), meta.astype(np.float32).astype(float)  # as the table keeps them
    cats = rng.integers(0, 40, (n, 3))
    found = pd.DataFrame({"h": range(n), "n0": list(content), "n1": [[float(m)] for m in meta], "c1": list(cats), "y": y})
    frame = lambda part: spark.createDataFrame([(int(r.h), r.n0.tolist(), r.n1, r.c1.tolist()) for r in part.itertuples()], "h long, n0 array<float>, n1 array<float>, c1 array<int>")
    return found, frame


def test_views_teach_each_other(spark):
    """Few labels: with pseudo-labels of all unlabelled rows the metadata view gets better."""
    found, frame = synthetic(spark)
    few, pool, rest = found[:200], frame(found[200:2000]), found[2000:]
    edges = quality.bin_edges(frame(found))
    parts, accuracy = quality._parts(rest), []
    for rounds in (0, 4):
        model = quality.co_train(few, pool, edges, rounds)
        accuracy.append(((model.views[1].logit(*parts[1]) > 0) == (rest["y"] > 0)).mean())
    assert accuracy[1] >= accuracy[0]
    assert ((model.scores(parts) > 0.5) == (rest["y"] > 0)).mean() > 0.85


def test_told_rows_are_sure_ones_and_bounded(spark):
    found, frame = synthetic(spark)
    model = quality.co_train(found[:500], frame(found[500:600]), quality.bin_edges(frame(found)), 0)
    p = [sigmoid(v.logit(*part)) for v, part in zip(model.views, quality._parts(found))]
    everything = quality.told_rows(frame(found), model.views, 0.5, 1, 10**6)
    for i in (0, 1):
        rows, labels = everything[i]
        sure = {h: float(x >= 0.5) for h, x in zip(found["h"], p[1 - i]) if x >= quality.SURE or x <= 1 - quality.SURE}
        assert dict(zip(rows["h"], labels)) == sure
    few = quality.told_rows(frame(found), model.views, 0.25, 1, 200)
    for i in (0, 1):
        assert set(few[i][0]["h"]) <= set(everything[i][0]["h"])
        assert 20 <= few[i][1].sum() <= 80 or not everything[i][1].sum() and len(few[i][1]) < 260


def test_quality_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, "s", 5), (1, None, None, "s", 5), (None, "x", "en", None, 6), (3, "y " * 9000, "en", "s", 7)], "doc_id long, text string, lang string, source string, h int")
    for labels, expected in (([], 1.0), ([(1, 1), (3, 0)], None)):
        model = learned(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = quality.scored(docs, model).collect()
        assert sorted(str(r.h) for r in rows) == ["5", "5", "6", "7"] and all(0 <= r.quality_score <= 1 for r in rows)
        assert expected is None or all(r.quality_score == expected for r in rows)
        views = quality.view_table(docs)
        assert sorted(str(r.id) for r in quality.view_scores(views, model).collect()) == ["1", "1", "3", "None"]
    assert quality.scored(docs.limit(0), model).count() == 0
    assert quality.view_scores(quality.view_table(docs.limit(0)), learned(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_toxicity_query_scores_each_document_by_the_model(spark, monkeypatch):
    """op4's scores against a logistic function written out for each document's set of features."""
    import math
    import zlib

    from symgraph.llm import toxicity

    models = []
    monkeypatch.setattr(toxicity, "train", lambda *a, f=toxicity.train, **k: models.append(f(*a, **k)) or models[-1])
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in toxicity.op4_counterfactual_toxicity(spark, sf).collect()}
    kept, weights, bias = models[0]
    weight = dict(zip(kept.tolist(), weights.tolist()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        value = bias + sum(weight.get(f, 0.0) for f in set(toxicity.features([d.text or ""])[0].tolist()))
        r = got[d.doc_id]
        assert math.isclose(r.score, 1 / (1 + math.exp(-value)), rel_tol=1e-9, abs_tol=1e-12)
        assert (r.held_out, r.predicted) == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2, int(r.score >= 0.3))


def test_features_of_terms_that_texts_have_are_kept(spark):
    from symgraph.llm import toxicity

    texts = [("a text that tells nothing of women", 0.0)] * 2 + [(f"word{i % 7} and more", float(i % 2)) for i in range(60)]
    kept, _, _ = toxicity.train(spark.createDataFrame(texts, "text string, y double"))
    assert np.isin(toxicity.features(["women"])[0], kept).all()
