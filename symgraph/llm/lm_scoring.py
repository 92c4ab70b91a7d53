"""Operator 6: log-likelihood of whole documents under a gated recurrent language model.

Three passes.  (1) Read every text once: its words become places in the list of distinct words of the
part that it is in, and whatever follows works on these numbers.  The counts of the tokens of all
training documents are a table of their own, grouped with partial aggregation, and never leave the
cluster whole.  (2) Train the model
(:mod:`gated_lm`) on every training document, each once: the documents are dealt to rounds by their
ids' hashes; in a round each partition trains a copy of the model on its documents, and the copies are
averaged, weighted by their tokens, slice by slice of their weights.  The first copies start from the
words' frequencies.  A copy has ``COPY`` tokens of a round at least, if there are so many: partitions
are put together until then.  ``PER_ROOT`` times the square root of the number of distinct words
(``VOCABULARY`` at least) may have tokens of their own, the most frequent first, equally frequent ones
all or none; all other words fall into groups by their first and last two letters, one for
``PER_GROUP`` such words (``GROUPS`` at least), and a group's probability is shared out by count.
(3) Score every document.  The counts of the ``KNOWN`` most frequent words at most (more only if the
model has more) go to the tasks; all rarer words of all documents are joined with the count table, and
the sums come back to their documents.

Which words are the most frequent follows from how many words have which count, a table of a bounded
number of rows (:func:`least_count`); only the words wanted come to the driver.

Tokens: bytes A-Z in lower case, runs without ``[\\x20\\x09-\\x0D]``, then one end token.

Defined results: null text counts as empty (one token, the end); repeated rows score alike; without
training documents every count is 0 and the model is uniform; an empty table gives an empty result;
a null id hashes as the empty string; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, exact_col, remove, session_conf, table, written
from .gated_lm import STEPS, GatedLM

VOCABULARY, GROUPS, KNOWN = 2000, 32, 200_000
PER_ROOT, PER_GROUP = 4, 16
#: Rates of the rounds of training, tokens of a copy in a round, its parallel streams at most, windows of a reading at least,
#: tokens that it reads at a time, and weights in a slice.
RATES, COPY, STREAMS, WINDOWS, READ, SLICE = (0.03, 0.008), 1_000_000, 512, 64, 1_200_000, 8192
#: The end token in the count table; it cannot be a word.
END = "\n"
#: Distinct words of a part at most (but for its last text's), and tokens that are scored at a time.
COUNTED, CHUNK = 300_000, 2_400_000


def tokens(text: str) -> list[bytes]:
    """The words of a text (the end token is not among them)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def group_of(word: str, groups: int = GROUPS) -> int:
    return zlib.crc32((word[0] + word[-2:]).encode("utf-8", "surrogatepass")) % groups


def _group_column(groups: int) -> F.Column:
    return F.when(F.col("word") != END, F.crc32(F.concat(F.left("word", F.lit(1)), F.right("word", F.lit(2))).cast("binary")) % groups).cast("int")


#: Texts of one round (-1: held out), read once: their distinct words, the end first, how often each comes, the texts' words as
#: places among these (32 bits), each text with its end, where each text ends (64 bits), and their ids.
PARTS = "round int, words array<binary>, counts array<long>, codes binary, ends binary, ids array<string>"


class _Part:
    """Texts of a round that wait to be handed on."""

    def __init__(self):
        self.places: defaultdict = defaultdict()
        self.places.default_factory = self.places.__len__  # a new word gets the next place
        self.places[END.encode()]
        self.ids, self.codes, self.size = [], [], 0

    def add(self, doc_id: str | None, text: str) -> None:
        words = tokens(text)
        words.append(END.encode())
        self.codes.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.size += len(words)

    def handed(self, r: int) -> pd.DataFrame:
        codes, ends = np.concatenate(self.codes), np.cumsum([len(c) for c in self.codes])
        counts = np.bincount(codes, minlength=len(self.places))
        return pd.DataFrame({"round": [r], "words": [list(self.places)], "counts": [counts], "codes": [codes.tobytes()], "ends": [ends.astype(np.int64).tobytes()], "ids": [self.ids]})


def read_once(docs: DataFrame, most: int = READ) -> DataFrame:
    """docs: id, text, and held_out, if some are -> ``PARTS`` of about ``most`` tokens at most; a text's round follows from the hash of its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, _Part] = {}
        for batch in batches:
            for doc_id, text, r in zip(batch["id"], batch["text"], batch["round"]):
                if r not in parts:
                    parts[r] = _Part()
                parts[r].add(doc_id, text)
                if parts[r].size >= most or len(parts[r].places) >= COUNTED:
                    yield parts.pop(r).handed(r)
        for r, part in parts.items():
            yield part.handed(r)

    held = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    of_round = F.when(held, -1).otherwise(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(len(RATES)))).cast("int")
    return docs.select(F.col("id").cast("string"), "text", of_round.alias("round")).mapInPandas(run, PARTS)


def count_tokens(parts: DataFrame) -> DataFrame:
    """(word, c) over all training texts, the end token included."""
    words = parts.filter("round >= 0").select(F.inline(F.arrays_zip("words", "counts")))
    return words.groupBy(F.col("words").cast("string").alias("word")).agg(F.sum("counts").alias("c"))


def few_rows(at_least: int) -> dict[str, str]:
    """Settings for reading ``PARTS``: a row has up to ``READ`` tokens, so few at a time, and ``at_least`` tasks where the files allow it."""
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.files.minPartitionNum": str(max(1, at_least))}


class Scorer:
    """What the tasks need: it grows with the square root of the number of distinct words."""

    def __init__(self, words: list[str], counts: np.ndarray, in_model: int, group_totals: np.ndarray, total: int, distinct: int, end_count: int):
        self.groups, self.first_group = len(group_totals), 1 + in_model
        self.total, self.base, self.end_count = total, float(np.log10(total + 0.5 * (distinct + 1))), end_count
        self.known = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
        self.logs = np.log10(np.append(counts, 0) + 0.5)
        self.token = np.array([*range(1, in_model + 1), *(1 + in_model + group_of(w, self.groups) for w in words[in_model:]), 0], np.int32)
        #: log10 of what a group's probability is divided by
        self.group = np.log10(group_totals[:, 0] + 0.5 * (group_totals[:, 1] + 1))
        self.model = GatedLM(np.concatenate([[end_count], counts[:in_model], group_totals[:, 0]]))

    def numbers(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model tokens of words, the end first; their places in ``known`` (of none, -1); those of the words, without the end, that are not there."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        number, new = self.token[found], np.flatnonzero(found < 0)[1:]
        number[new] = [self.first_group + group_of(words[i].decode("utf-8", "surrogatepass"), self.groups) for i in new.tolist()]
        return number, found, new

    def documents(self, words: Sequence[bytes], codes: bytes, ends: bytes) -> list[np.ndarray]:
        """Model tokens of each text of a part, with its end."""
        return np.split(self.numbers(words)[0][np.frombuffer(codes, np.int32)], np.frombuffer(ends, np.int64)[:-1])

    def rows(self, words: Sequence[bytes], codes: bytes, ends: bytes) -> Iterator[tuple[np.ndarray, float, float, int, list[str], list[int]]]:
        """For each text of a part: model tokens with the end; sum of log10(c + 0.5) of known words; the same of those outside the model, less their groups' logs; known words; the others and how often each comes."""
        number, found, new = self.numbers(words)
        codes, ends = np.frombuffer(codes, np.int32), np.frombuffer(ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        logs = self.logs[found]
        logs[0] = logs[new] = 0
        outside = np.where(found >= self.first_group - 1, logs, 0)
        outside[number >= self.first_group] -= self.group[number[number >= self.first_group] - self.first_group]
        sums, out = np.add.reduceat(logs[codes], starts), np.add.reduceat(outside[codes], starts)
        unknown, names = np.full(len(words), -1, np.int64), [words[i].decode("utf-8", "surrogatepass") for i in new.tolist()]
        unknown[new] = np.arange(len(new))
        which = unknown[codes]
        at = np.flatnonzero(which >= 0)
        pairs, often = np.unique(np.searchsorted(ends, at, side="right") * max(1, len(new)) + which[at], return_counts=True)
        text, which = np.divmod(pairs, max(1, len(new)))
        rest, often = [names[i] for i in which.tolist()], often.tolist()
        bounds = np.searchsorted(text, np.arange(len(ends) + 1)).tolist()
        for i, doc in enumerate(np.split(number[codes], ends[:-1])):
            a, b = bounds[i], bounds[i + 1]
            yield doc, float(sums[i]), float(out[i]), len(doc) - 1 - sum(often[a:b]), rest[a:b], often[a:b]


#: Copies of a slice of the weights that are averaged in one group at most.
MERGED = 64
COPIES = "slice int, copy int, read long, weights binary"


def least_count(counts: DataFrame, most: int) -> int:
    """The least c such that ``most`` rows at most have a count of c or more.

    Counts above 2048 are rounded down to eleven binary digits, so at most some 60,000 rows come to the driver.
    """
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("c")) - 10, F.lit(0)))
    found = counts.groupBy((F.floor(F.col("c") / unit) * unit).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toPandas()
    fits = found["n"].cumsum().to_numpy() <= most
    return int(found["c"][fits].min()) if fits.any() else 1 << 62


def learn(counts: DataFrame, train: DataFrame, tasks: int = 1, vocabulary: int = VOCABULARY, known: int = KNOWN) -> Scorer:
    """Counts (a table) and all training texts (id, text, or their ``PARTS``) -> the trained scorer."""
    parts = train if "codes" in train.columns else read_once(train)
    words = counts.filter(F.col("word") != END)
    total, distinct, end_count = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    vocabulary = max(vocabulary, int(PER_ROOT * (distinct or 0) ** 0.5))
    groups = max(GROUPS, vocabulary // PER_GROUP)
    top = words.filter(F.col("c") >= least_count(words, max(known, vocabulary))).toPandas().sort_values(["c", "word"], ascending=[False, True])  # ``known`` or ``vocabulary`` rows at most
    c = top["c"].to_numpy(float)
    in_model = len(c) if len(c) <= vocabulary else int((c > c[vocabulary]).sum())
    rare = words.groupBy(_group_column(groups).alias("g")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # one row a group
    totals = np.zeros((groups, 2))
    totals[rare["g"].to_numpy(int)] = rare[["n", "v"]].to_numpy(float)
    for w, n in zip(top["word"][:in_model], c[:in_model]):
        totals[group_of(w, groups)] -= (n, 1)
    scorer = Scorer(top["word"].tolist(), c, in_model, totals, int(total or 0), int(distinct or 0), int(end_count or 0))
    copies = max(1, scorer.total // (len(RATES) * COPY))
    for r, rate in enumerate(RATES):
        train_round(parts.filter(F.col("round") == r).select("words", "codes", "ends").coalesce(copies), scorer, rate, tasks)
    return scorer


def train_round(parts: DataFrame, scorer: Scorer, rate: float, tasks: int = 1) -> int:
    """Train a copy of the model on each partition of ``parts``, average the copies; gives the number of tokens read."""
    shared = parts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, adam, docs, size, read = shared.value, {}, [], 0, 0
        model = own.model.copy()

        def learned() -> int:
            model.train(docs, rate=rate, streams=min(STREAMS, max(1, size // (STEPS * WINDOWS))), falling=False, adam=adam)
            docs.clear()
            return size

        for batch in batches:
            for part in zip(batch["words"], batch["codes"], batch["ends"]):
                for doc in own.documents(*part):
                    docs.append(doc)
                    size += len(doc)
                    if size >= READ:
                        read, size = read + learned(), 0
        read += learned()
        if read:
            row = model.weights().astype(np.float32)
            for a in range(0, len(row), SLICE * 64):
                cuts = range(a, min(a + SLICE * 64, len(row)), SLICE)
                yield pd.DataFrame({"slice": [c // SLICE for c in cuts], "copy": TaskContext.get().partitionId(), "read": read, "weights": [row[c : c + SLICE].tobytes() for c in cuts]})

    scratch: list[str] = []
    with session_conf(parts.sparkSession, few_rows(tasks)):
        copies = written(parts.mapInPandas(run, COPIES), "lm-copies", scratch)
        found = averaged(copies, copies.agg(F.max("copy")).first()[0] or 0).toPandas().sort_values("slice")  # one model
    shared.unpersist()
    for path in scratch:
        remove(parts.sparkSession, path)
    if not len(found):
        return 0
    scorer.model.put(np.frombuffer(b"".join(found["weights"]), np.float32))
    return int(found["read"].iloc[0])


def averaged(copies: DataFrame, last: int) -> DataFrame:
    """The mean of the copies 0 to ``last``, weighted by the tokens each has read, slice by slice.

    In stages: no group has more than ``MERGED`` copies of a slice, however many there are.
    """

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(n * np.frombuffer(w, np.float32).astype(float) for n, w in zip(group["read"], group["weights"]))
        n = int(group["read"].sum())
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "copy": [group["part"].iloc[0]], "read": [n], "weights": [(total / n).astype(np.float32).tobytes()]})

    n = last + 1
    while True:
        parts = -(-n // MERGED)
        copies = copies.withColumn("part", (F.col("copy") % parts).cast("int")).groupBy("slice", "part").applyInPandas(mean, COPIES)
        if parts == 1:
            return copies
        n = parts


def score_documents(parts: DataFrame, scorer: Scorer, counts: DataFrame, tasks: int = 1) -> DataFrame:
    """``PARTS`` of all documents -> id string, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = parts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = shared.value, TaskContext.get().partitionId() << 40
        end_log = float(np.log10(own.end_count + 0.5))
        ids, held, rows, size = [], [], [], 0

        def scored() -> pd.DataFrame:
            model = own.model.log_likelihood([r[0] for r in rows]) / np.log(10)
            return pd.DataFrame({
                "row": range(at, at + len(rows)), "id": pd.Series(ids, dtype=object), "held_out": held,
                "n_tokens": [len(r[0]) for r in rows], "n_known": [r[3] + (own.end_count > 0) for r in rows],
                "base_score": [r[1] + end_log - len(r[0]) * own.base for r in rows],
                "score": [m + r[2] for m, r in zip(model, rows)], "rest": [r[4] for r in rows], "often": [r[5] for r in rows],
            })

        for batch in batches:
            for r, words, codes, ends, of_part in zip(batch["round"], batch["words"], batch["codes"], batch["ends"], batch["ids"]):
                for doc_id, row in zip(of_part, own.rows(words, codes, ends)):
                    ids.append(doc_id)
                    held.append(r < 0)
                    rows.append(row)
                    size += len(row[0])
                    if size >= CHUNK:
                        yield scored()
                        at += len(rows)
                        ids, held, rows, size = [], [], [], 0
        if rows:
            yield scored()

    with session_conf(parts.sparkSession, few_rows(tasks)):
        found = written(
            parts.drop("counts").mapInPandas(run, "row long, id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<string>, often array<long>"),
            "lm-scores",
        )
    rest = found.select("row", F.inline(F.arrays_zip("rest", "often"))).join(counts, F.col("rest") == F.col("word"), "left")
    sums = rest.groupBy("row").agg(F.sum(F.col("often") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    return found.drop("rest", "often").join(sums, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; four fifths of them are learned from."""
    docs = table(spark, sf_dir, "documents").select(exact_col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (crc_bucket("doc_id", 5) == 1).alias("held_out"))
    tasks, scratch = docs.rdd.getNumPartitions(), []
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        parts = written(read_once(docs), "lm-parts", scratch)
    with session_conf(spark, few_rows(tasks)):
        counts = written(count_tokens(parts), "lm-counts")  # the result reads it
    found = score_documents(parts, learn(counts, parts, tasks), counts, tasks)
    for path in scratch:
        remove(spark, path)
    return found.withColumn("id", F.col("id").cast(docs.schema["id"].dataType)).withColumnRenamed("id", "doc_id")
