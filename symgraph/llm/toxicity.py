"""Operator 4: a counterfactually regularised toxicity classifier.

A text is the set of its lower-cased words and of the first four and five bytes of longer words
(inflected forms share them), hashed.  A logistic regression on the most informative of these is
trained on a bounded sample of labelled texts.  For every labelled text that mentions an identity
term, copies with the term swapped for others are made; every other labelled text gets a copy with
one term put in, a different one from text to text.  The squared change of the score (before the
logistic function) from a text to its copies is penalised; so a mere mention of a group does not move
a score.
Training happens on the driver on at most ``SAMPLE`` rows; scoring is one pass over all texts,
which are looked at whole.

Defined results: null text counts as empty and scores like one; texts with no known feature score
the bias; repeated rows score alike; a table without labels (or with one class only) gives the
share of toxic labels, 0 without any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, exact_col, session_conf, table, written
from .linear import Rows, fit, informative, sigmoid
from .wordhash import _BYTE, _power, mix, words

#: Labelled rows that are learned from at most: those with the least hash of their id.
SAMPLE = 20_000
FEATURES, KEPT, LEAST_ROWS = 1 << 20, 3000, 3
FAIRNESS = 1.0
CHUNK = 500_000
#: Identity terms that are swapped for each other: English, French, German and Spanish ones, each in one group only.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "african", "european"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulmane", "chrétienne", "juive"),
    ("noir", "blanc", "asiatique", "africain", "européen"),
    ("homosexuel", "bisexuel", "transgenre", "hétérosexuel"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("fille", "garçon"),
    ("immigré", "réfugié", "citoyen"),
    ("immigrés", "réfugiés", "citoyens"),
    ("handicapé", "sourd", "aveugle"),
    ("vieux", "jeune"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("mädchen", "junge"),
    ("einwanderer", "flüchtling", "bürger"),
    ("behinderte", "gehörlose", "blinde"),
    ("alten", "jungen"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático", "africano", "europeo"),
    ("homosexual", "lesbiana", "transgénero", "heterosexual"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("niña", "niño"),
    ("inmigrante", "refugiado", "ciudadano"),
    ("inmigrantes", "refugiados", "ciudadanos"),
    ("discapacitado", "sordo", "ciego"),
    ("viejo", "joven"),
)
_LOG = logging.getLogger(__name__)
Groups = tuple[tuple[str, ...], ...]


@functools.lru_cache(maxsize=8)
def _terms(identity: Groups) -> tuple[dict[str, tuple[str, ...]], re.Pattern]:
    group = {term: group for group in identity for term in group}
    return group, re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(group, key=len, reverse=True))) + r")(?!\w)" if group else r"(?!)")


def swaps(text: str, identity: Groups = IDENTITY) -> list[str]:
    """The text with every identity term replaced by the next and by the next but one of its group."""
    low, (groups, terms) = text.lower(), _terms(identity)
    if not terms.search(low):
        return []
    turn = lambda k: lambda m: (g := groups[m[1]])[(g.index(m[1]) + k) % len(g)]
    return [t for t in dict.fromkeys(terms.sub(turn(k), low) for k in (1, 2)) if t != low]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, text numbers); a feature may come more than once."""
    hashes, bounds, data, starts, ends = words([t.lower() for t in texts])
    raw = np.frombuffer(data, np.uint8)
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    bare = ends - np.isin(raw[np.maximum(ends - 1, 0)], list(b".,;:!?\"')")) if len(ends) else ends
    whole = np.maximum(bare, starts + 1) if len(ends) else ends
    found, owners = [mix((sums[whole] - sums[starts]) * down[starts])], [owner]
    for n in (4, 5):
        longer = whole - starts > n
        s = starts[longer]
        found.append(mix((sums[s + n] - sums[s]) * down[s] + np.uint64(n)))
        owners.append(owner[longer])
    return (np.concatenate(found) >> np.uint64(44)).astype(np.int64), np.concatenate(owners)


def _sets(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for text in texts:
        out.append(np.unique(features([text])[0]))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents, those with the least hash of their id."""
    known = labels.select(exact_col(id_col).alias("id"), exact_col(label).cast("double").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded by the parameter, so it may be broadcast
    return docs.select(exact_col(id_col).alias("id"), F.coalesce(exact_col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")


def inserted(text: str, identity: Groups = IDENTITY) -> str | None:
    """The identity term that is put into a text without any."""
    terms = [t for group in identity for t in group]
    return terms[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(terms)] if terms else None


def train(sample: DataFrame, fairness: float = FAIRNESS, identity: Groups = IDENTITY) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) from a bounded sample (text, y).

    The numbers of pairs are logged, as a warning if there are none: then nothing is penalised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 50):
                part = batch.iloc[a : a + 50]
                other = [_sets(swaps(t, identity)) for t in part["text"]]
                own = _sets(part["text"].tolist())
                put = [[] if o or (term := inserted(t, identity)) is None else np.setdiff1d(features([term])[0], s) for t, o, s in zip(part["text"], other, own)]
                yield pd.DataFrame({"y": part["y"], "own": own, "swapped": other, "put": [list(map(int, p)) if len(p) else None for p in put]})

    with session_conf(sample.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "100"}):
        rows = written(sample.mapInPandas(run, "y double, own array<int>, swapped array<array<int>>, put array<int>"), "toxic-sample")
    counted = rows.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).filter(f"n >= {LEAST_ROWS}").toPandas()  # at most FEATURES rows
    total, positive = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total or not 0 < positive < total:
        share = np.clip(positive / total if total else 0.0, 1e-6, 1 - 1e-6)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    kept = informative(counted["f"].to_numpy(np.int64), counted["n"].to_numpy(float), counted["pos"].to_numpy(float), total, positive, KEPT)
    terms = np.unique(features([t for group in identity for t in group])[0]).tolist()
    used = rows.select(F.explode("own").alias("f")).filter(F.col("f").isin(terms)).distinct().toPandas()  # no more than the terms' features
    kept = np.union1d(kept, used["f"].to_numpy(np.int64))  # a term that a text has can be penalised, however little it tells

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = lambda found: np.intersect1d(np.asarray(found, np.int64), kept)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "own": [inside(r) for r in batch["own"]], "swapped": [[inside(r) for r in others] for others in batch["swapped"]], "put": [None if p is None else inside(p) for p in batch["put"]]})

    found = rows.mapInPandas(keep, rows.schema).toPandas()  # informative features of a bounded sample only
    take = lambda sets: Rows([np.searchsorted(kept, np.asarray(s, np.int64)) for s in sets], len(kept))
    swapped = [(own, other) for own, others in zip(found["own"], found["swapped"]) for other in others]
    put = [(added, []) for added in found["put"] if added is not None]  # what a text and its copy share cancels out
    pairs = swapped + put
    _LOG.log(logging.INFO if pairs else logging.WARNING, "%d swapped pairs, %d inserted ones from %d labelled texts", len(swapped), len(put), total)
    weights, bias = fit(take(found["own"]), found["y"].to_numpy(float), swapped=(take([p[0] for p in pairs]), take([p[1] for p in pairs])), fairness=fairness)
    return kept, weights, bias


def scores(texts: list[str], model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    kept, weights, bias = model
    table_ = np.zeros(FEATURES)
    table_[kept] = weights
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        found, owner = features(texts[a:b])
        some = table_[found] != 0
        pair = np.unique(owner[some] * FEATURES + found[some])
        out.append(sigmoid(np.bincount(pair // FEATURES, table_[pair % FEATURES], b - a) + bias))
        a = b
    return np.concatenate([*out, np.zeros(0)])


def score_column(model: tuple[np.ndarray, np.ndarray, float]):
    """A pandas UDF: text -> score."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scores([t or "" for t in texts], model))

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, identity: Groups = IDENTITY):
    """``identity``: groups of lower-case terms that are swapped for each other."""
    return score_column(train(labelled_sample(docs, labels, "toxic", id_col, text_col, rows), identity=identity))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; labels are learned from three quarters of the rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = learn(docs, labels.filter(crc_bucket("doc_id", 4) != 2))
    return docs.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
