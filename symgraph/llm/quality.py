"""Operator 5: quality by co-training of two views.

The content view sees the text alone (rates of character classes, shapes and repetition of words and
lines, layout); the metadata view sees what a page carries beside its text: language, source, both
together, and the length that the table states.  Both turn their numbers into quantile bins, whose
edges are taken over all documents, and are logistic regressions.  In each round either view scores
every unlabelled document; of those that it is surest of, as many of either kind as the labels have,
the other view learns.  At the end each view is calibrated on labelled rows that neither has learned
from, and a last regression on the two calibrated scores, fitted on the same rows, combines them.

The views of all documents are computed once and written as a narrow table; rounds and scoring read
that.  The driver gets bounded samples only: ``SAMPLE`` labelled rows (least hashes of ids), and in a
round about ``TOLD`` rows for each view and label, drawn by hash from all the confident ones.

Defined results: null text counts as empty; null language, source or length is a value of its own;
without labels of both kinds every score is the share of good labels (1 without any label); repeated
rows score alike; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, session_conf, table, written
from .linear import Rows, fit, sigmoid
from .wordhash import mix, words

SAMPLE, TOLD, ROUNDS, SURE = 20_000, 2_000, 3, 0.95
THRESHOLD = 0.5
HASHED = 256
#: The columns of the metadata view: language, source, stated length.
META = ("lang", "source", "n_chars")
#: Where the bins of a number are cut.
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99)
BINS = len(QUANTILES) + 1
#: Code points of the texts that are worked on at a time.
CHUNK = 500_000
_CLASSES = [list(b".,;:?"), list(b"!"), list(b"|"), list(b"#$%&*@^~+=_<>{}\\/"), list(b"()[]\"'-"), list(range(48, 58)), list(range(65, 91)), list(range(97, 123)), [10], [32], list(range(128, 256)), [*range(0, 9), *range(11, 32), 127]]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[_c] = _i
_DIGIT, _UPPER, _LOWER, _HIGH = 5, 6, 7, 10
#: Numbers and categories of the content view and of the metadata view.
SHAPES = ((len(_CLASSES) + 10, 0), (1, 3))


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    both = mix(keys ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(both, return_index=True)
    return np.bincount(owner[first], minlength=n)


def content_view(texts: list[str]) -> np.ndarray:
    """A row for each text: rates of byte classes; then words: mean length, share of different ones and of
    different runs of three, of those without small letters, ending in punctuation, not all letters; then
    lines: share of different ones, logarithm of their number, of their mean and of their greatest length.
    """
    n = len(texts)
    out = np.zeros((n, SHAPES[0][0]))
    if not n:
        return out
    hashes, bounds, data, starts, ends = words(texts)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])  # with the line end behind each
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[raw]
    counts = np.bincount(owner * (len(_CLASSES) + 1) + kinds, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, : len(_CLASSES)].astype(float)
    counts[:, 8] -= 1
    out[:, : len(_CLASSES)] = counts / np.maximum(sizes - 1, 1)[:, None]
    k = np.diff(bounds)
    of, some = np.repeat(np.arange(n), k), np.maximum(k, 1)
    per_word = lambda flags: np.bincount(of, flags, n) / some
    sums = {c: np.concatenate([[0], np.cumsum(kinds == c)]) for c in (_UPPER, _LOWER, _HIGH)}
    within = {c: s[ends] - s[starts] for c, s in sums.items()}
    last = kinds[ends - 1] if len(ends) else kinds[:0]
    three = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    runs = mix(hashes[three] + mix(hashes[three + 1] + mix(hashes[three + 2]))) if len(three) else np.zeros(0, np.uint64)
    # a line's key is the sum of its words' hashes, each mixed with its place in the line
    line_ends = np.flatnonzero(raw == 10)
    line_of_word = np.searchsorted(line_ends, starts)
    first_of_line = np.searchsorted(line_of_word, line_of_word)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + (np.arange(len(hashes)) - first_of_line).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)])
    filled, first_word = np.unique(line_of_word, return_index=True)
    line_key = running[np.append(first_word, len(hashes))[1:]] - running[first_word]
    line_owner = owner[line_ends[filled]]
    all_lines = np.bincount(owner[line_ends], minlength=n)  # one at least
    lengths = np.diff(np.concatenate([[-1], line_ends])) - 1
    greatest = np.zeros(n)
    np.maximum.at(greatest, owner[line_ends], lengths)
    chars = np.array([len(t) for t in texts], float)
    out[:, len(_CLASSES) :] = np.column_stack([
        chars / some, _distinct(hashes, of, n) / some, _distinct(runs, of[three], n) / np.maximum(k - 2, 1),
        per_word((within[_LOWER] == 0) & (within[_UPPER] > 0)), per_word(~np.isin(last, (_DIGIT, _UPPER, _LOWER, _HIGH))), per_word(within[_UPPER] + within[_LOWER] + within[_HIGH] < ends - starts),
        _distinct(line_key, line_owner, n) / np.maximum(np.bincount(line_owner, minlength=n), 1), np.log1p(all_lines), np.log1p((sizes - all_lines) / all_lines), np.log1p(greatest),
    ])
    return out


def metadata_view(lang: str | None, source: str | None, length: float | None) -> tuple[float, list[int]]:
    """The stated length (-1: none) as a logarithm, and the hashes of language, source and both."""
    number = -1.0 if length is None or not length >= 0 else float(np.log1p(length))
    return number, [zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % HASHED for kind, value in (("lang", lang), ("source", source), ("both", (lang, source)))]


class View:
    """Binned numbers and hashed categories -> logistic regression, then a calibration."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.width = len(self.edges) * BINS + HASHED
        self.weights, self.bias, self.slope, self.shift = np.zeros(self.width), 0.0, 1.0, 0.0

    def _cells(self, numbers: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, numbers.T)], 1).reshape(len(numbers), len(self.edges))

    def learn(self, numbers: np.ndarray, categories: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        """Fits one weight for each edge that a number exceeds, then keeps their sums, one for each bin."""
        first = np.arange(len(self.edges)) * BINS
        passed = [np.concatenate([np.arange(a, a + n) for a, n in zip(first, row)] + [c + len(self.edges) * BINS]) for row, c in zip(self._cells(numbers), categories)]
        w, self.bias = fit(Rows(passed, self.width), y, l2=2e-2, steps=200, sample_weight=share)
        edges = w[: len(self.edges) * BINS].reshape(-1, BINS)
        self.weights = np.concatenate([np.concatenate([np.zeros((len(edges), 1)), np.cumsum(edges, 1)[:, :-1]], 1).ravel(), w[len(self.edges) * BINS :]])

    def raw(self, numbers: np.ndarray, categories: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0)
        cells = np.concatenate([self._cells(numbers) + np.arange(len(self.edges)) * BINS, categories + len(self.edges) * BINS], 1)
        return self.weights[cells].sum(axis=1) + self.bias

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = _line(raw[:, None], y)

    def logit(self, numbers: np.ndarray, categories: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(numbers, categories) * self.slope + self.shift, -12, 12)


def _line(x: np.ndarray, y: np.ndarray):
    """Non-negative slopes and shift of a logistic regression on few numbers (damped Newton steps, ridge)."""
    a = np.column_stack([np.clip(x, -30, 30), np.ones(len(x))])
    w = np.zeros(a.shape[1])
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (a @ w)).sum() + 0.05 * (w @ w))
    for _ in range(50):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        move, length = np.linalg.solve(h, a.T @ (y - p) - 0.1 * w), 1.0
        bounded = lambda v: np.append(np.clip(v[:-1], 0, 50), v[-1])
        while length > 1e-4 and loss(bounded(w + length * move)) > loss(w):
            length /= 2
        if length <= 1e-4:
            break
        w = bounded(w + length * move)
    return (float(w[0]), float(w[1])) if len(w) == 2 else (w[:-1], float(w[-1]))


class Model:
    """The two calibrated views and their combination; ``share`` alone if nothing could be learned."""

    def __init__(self, share: float):
        self.share, self.views, self.mixing, self.shift = share, None, None, 0.0

    def scores(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """``parts``: numbers and categories of either view."""
        if self.views is None:
            return np.full(len(parts[0][0]), self.share)
        return sigmoid(np.column_stack([v.logit(*p) for v, p in zip(self.views, parts)]) @ self.mixing + self.shift)


def _viewed(text: pd.Series, lang: pd.Series, source: pd.Series, length: pd.Series) -> pd.DataFrame:
    """n0, n1 (numbers) and c1 (categories) of both views; long batches are worked on in parts."""
    texts, a, content = [t or "" for t in text], 0, []
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        content += list(content_view(texts[a:b]).astype(np.float32))
        a = b
    beside = [metadata_view(x, s, n) for x, s, n in zip(lang, source, length)]
    return pd.DataFrame({"n0": pd.Series(content, dtype=object), "n1": pd.Series([[m[0]] for m in beside], dtype=object), "c1": pd.Series([m[1] for m in beside], dtype=object)})


def _inputs(docs: DataFrame, text: str, meta: tuple[str, str, str]) -> list:
    named = {c.lower(): c for c in docs.columns}
    lang, source, length = (exact_col(named[c.lower()]) if c.lower() in named else F.lit(None) for c in meta)
    return [exact_col(text), lang.cast("string"), source.cast("string"), length.cast("double")]


def view_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = META) -> DataFrame:
    """id, n0, n1, c1 of every row, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[["id"]], _viewed(*(batch[c] for c in names))], axis=1)

    names = ["text", "lang", "source", "length"]
    rows = docs.select(exact_col(id_col).cast("string").alias("id"), *(c.alias(n) for c, n in zip(_inputs(docs, text_col, meta), names)))
    with session_conf(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        return written(rows.mapInPandas(run, "id string, n0 array<float>, n1 array<float>, c1 array<int>"), "quality-views")


def _parts(found: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers and categories of both views of rows of a :func:`view_table`."""
    return [
        (np.array(found[f"n{i}"].tolist(), float).reshape(len(found), SHAPES[i][0]), np.array(found["c1"].tolist(), np.int64).reshape(len(found), SHAPES[1][1])[:, : SHAPES[i][1]])
        for i in (0, 1)
    ]


def bin_edges(views: DataFrame) -> list[list[np.ndarray]]:
    """For every number of both views the edges of its bins, from all rows."""
    wanted = [F.percentile_approx(F.col(f"n{i}")[j], list(QUANTILES), 1000) for i in (0, 1) for j in range(SHAPES[i][0])]
    found = [np.unique(e) if e is not None else np.zeros(0) for e in views.agg(*wanted).first()]
    return [found[: SHAPES[0][0]], found[SHAPES[0][0] :]]


def told_rows(unlabelled: DataFrame, views: list[View], share: float, turn: int, most: int = TOLD) -> list[tuple[pd.DataFrame, np.ndarray]]:
    """For each view the rows of ``unlabelled`` that the other one is told about, and their labels.

    Either view scores all rows; of those it is ``SURE`` about a draw by hash, ``most`` rows in all on
    average at most, good and bad ones as the labels have them.
    """

    @F.pandas_udf("array<double>")
    def sure(n0: pd.Series, n1: pd.Series, c1: pd.Series) -> pd.Series:
        p = [sigmoid(v.logit(*part)) for v, part in zip(views, _parts(pd.DataFrame({"n0": n0, "n1": n1, "c1": c1})))]
        return pd.Series(list(np.stack(p, 1)))

    kinds = [f"sure{i}{good}" for i in (0, 1) for good in (0, 1)]
    is_kind = {f"sure{i}{good}": F.col("p")[i] >= SURE if good else F.col("p")[i] <= 1 - SURE for i in (0, 1) for good in (0, 1)}
    scored_ = unlabelled.withColumn("p", sure("n0", "n1", "c1"))
    counts = scored_.agg(*(F.sum(c.cast("long")).alias(k) for k, c in is_kind.items())).first()
    room = {k: most * (share if k.endswith("1") else 1 - share) for k in kinds}
    draw = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 30))
    taken = {k: c & (draw < F.lit(int((1 << 30) * min(1.0, room[k] / max(counts[k] or 0, 1e-9))))) for k, c in is_kind.items()}
    wanted = scored_.select("h", "n0", "n1", "c1", *(c.alias(k) for k, c in taken.items())).filter(" or ".join(kinds))
    found = wanted.toPandas().sort_values("h", kind="stable")  # bounded by ``most``
    out = []
    for i in (0, 1):
        other = found[found[f"sure{1 - i}0"] | found[f"sure{1 - i}1"]]
        out.append((other, other[f"sure{1 - i}1"].to_numpy(float)))
    return out


def co_train(labelled: pd.DataFrame, unlabelled: DataFrame, edges: list[list[np.ndarray]], rounds: int = ROUNDS) -> Model:
    """labelled: a bounded sample of a :func:`view_table` with y; unlabelled: all its other rows."""
    y = labelled["y"].to_numpy(float)
    model = Model(float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 5 == 0  # for calibration and combination only
    if len(y) < 20 or not 0 < y[~held].mean() < 1 or not 0 < y[held].mean() < 1:
        return model
    own, views = _parts(labelled), [View(e) for e in edges]
    extra: list[tuple[pd.DataFrame, np.ndarray]] = [(labelled.iloc[:0], np.zeros(0))] * 2  # what each view was told by the other
    at = lambda rows, i: [a[rows] for a in own[i]]

    def learn_all(rows: np.ndarray) -> None:
        for i in (0, 1):
            told = _parts(extra[i][0])[i]
            x = [np.concatenate([a, b]) for a, b in zip(at(rows, i), told)]
            views[i].learn(*x, np.concatenate([y[rows], extra[i][1]]), np.concatenate([np.ones(rows.sum()), np.full(len(extra[i][1]), 0.5)]))

    for turn in range(rounds + 1):
        learn_all(~held)
        for i in (0, 1):
            views[i].calibrate(views[i].raw(*at(held, i)), y[held])
        if turn < rounds:
            new = told_rows(unlabelled, views, model.share, turn)
            # what a view was told last about a document counts
            extra = [(rows := pd.concat([new[i][0], extra[i][0]]).assign(label=np.concatenate([new[i][1], extra[i][1]])).drop_duplicates("h"), rows["label"].to_numpy(float)) for i in (0, 1)]
    model.views = views
    model.mixing, model.shift = _line(np.column_stack([views[i].logit(*at(held, i)) for i in (0, 1)]), y[held])
    learn_all(np.ones(len(y), bool))  # once more, with the rows that calibration no longer needs
    return model


def learn(views: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Co-train on a :func:`view_table`: at most ``sample`` labelled ids, one row of each, and all unlabelled rows."""
    known = labels.select(exact_col(id_col).cast("string").alias("id"), exact_col("quality").cast("double").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded by the parameter, so it may be broadcast
    rows = views.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("n0", "n1", "c1")).alias("v"), F.min("y").alias("y"))
    labelled = rows.select(F.xxhash64("id").alias("h"), "v.*", "y").toPandas().sort_values("h", kind="stable", ignore_index=True)
    others = views.join(known.select("id"), "id", "left_anti").select(F.xxhash64("id").alias("h"), "n0", "n1", "c1")
    return co_train(labelled, others, bin_edges(views), rounds)


def _column(model: Model, prepare):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_parts(prepare(*columns))))

    return run


def view_scores(views: DataFrame, model: Model, out: str = "quality_score") -> DataFrame:
    """id and the combined score (0 to 1, higher: better) of every row of a :func:`view_table`."""
    score = _column(model, lambda n0, n1, c1: pd.DataFrame({"n0": n0, "n1": n1, "c1": c1}))
    return views.select("id", score("n0", "n1", "c1").alias(out))


def scored(docs: DataFrame, model: Model, out: str = "quality_score", text_col: str = "text", meta: tuple[str, str, str] = META) -> DataFrame:
    """``docs`` with the combined score as one more column."""
    return docs.withColumn(out, _column(model, _viewed)(*_inputs(docs, text_col, meta)))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the combination of both views, trained on all labels within the bound."""
    docs = table(spark, sf_dir, "documents")
    views = view_table(docs)
    out = view_scores(views, learn(views, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "quality_score", (F.col("quality_score") >= THRESHOLD).alias("good"))
