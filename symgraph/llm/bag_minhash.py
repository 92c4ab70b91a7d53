"""Operator 2: near duplicates by BagMinHash.

A text is the multiset of its five-word shingles.  Each shingle owns Poisson processes over the
dyadic levels of the weight axis, (0,1], (1,2], (2,4], (4,8] ...: a point has a time, a slot of the
signature and a discretised weight, and counts for a text in which the shingle occurs at least that
often.  The earliest point of each slot is the signature; two texts agree in a slot with
probability sum(min) / sum(max) of their counts, the weighted Jaccard similarity, without bias.
Processes are followed only to the time by which all slots are expected to be full, further only
for texts that still have an empty one, so most shingles cost a single exponential variate.

Signatures are cut into bands.  Texts that share a band are candidates; a candidate pair is a link
if its exact multiset overlap is 0.8 or more.  Not all pairs of a bucket are verified: first every
text is compared with the bucket's hub (the member with most bucket mates over all bands) and the
links are merged into components; then only pairs in different components are left, and of these
the join itself keeps those whose two-bit sketches of the signatures agree about as often as a link
demands (a link fails that test with a probability below 1 in 10 million, the one with which it shares
no band) and whose parities do not rule a link out: a text's shingles fall into 1024
cells, and each cell in which two texts have an odd and an even number holds at least one shingle
that only one of them has, so that too many such cells prove the overlap to be below the threshold.
So a bucket of thousands of near copies costs one comparison each, pairs that merely resemble each
other are not formed, and links between components are lost with those probabilities only.  Equal word
sequences are one text from the start, however many rows have it.

Joins on a text or a class that a third of all rows may share are written before anything is grouped
by their key, so that a skewed one can be split.  Tables that nothing reads any more are deleted.

Defined results: null text counts as empty; texts without words are equal to each other; a text of
one to four words has one shingle; repeated rows are copies; a null id is never a class's id unless
all ids of the class are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, remove, session_conf, table, written
from .wordhash import mix, multiset, shingles

BANDS, ROWS, THRESHOLD = 40, 5, 0.8
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 5.5
#: Code points of the texts that are worked on at a time.
CHUNK = 400_000
#: 64-bit words of the parities.
PARITY = 16
#: What :func:`band_keys` gives for a text.
TRAITS = ("keys", "sketch", "parity", "total")
_WHITE = "[\\x20\\x09-\\x0D]+"


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def bag_signatures(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """n signatures of ``size`` 64-bit values from the multisets of :func:`wordhash.multiset`."""
    total = np.bincount(owner, counts, n)
    # one process for each shingle and level: level 0 is (0, 1], level j is (2^(j-1), 2^j]
    parts = [(hashes, owner, counts, np.zeros(len(hashes), np.int64))]
    j = 1
    while (up := counts > 1 << (j - 1)).any():
        parts.append((hashes[up], owner[up], counts[up], np.full(int(up.sum()), 1 << (j - 1))))
        j += 1
    seed0, own0, weight0, low0 = (np.concatenate(x) for x in zip(*parts))
    seed0 = mix(seed0 + low0.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((n, size), np.uint64)
    limit = size / np.maximum(total, 1) * (np.log(size) + 3)
    open_texts = total > 0
    while open_texts.any():
        use = open_texts[own0]
        seed, own, weight, low = seed0[use], own0[use], weight0[use], low0[use]
        rate = np.maximum(low, 1).astype(np.float64)
        time = np.zeros(len(seed))
        when, where, what = [], [], []
        step = 0
        while len(seed):
            step += 1
            point = mix(seed + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
            time = time - np.log(_uniform(point)) / rate
            live = time <= limit[own]
            seed, own, weight, low, rate, time, point = (x[live] for x in (seed, own, weight, low, rate, time, point))
            place = mix(point ^ np.uint64(0x5851F42D4C957F2D))
            level = low + 1 + (_uniform(mix(place)) * rate).astype(np.int64)
            counted = level <= weight
            when.append(time[counted])
            where.append(own[counted] * size + ((place[counted] >> np.uint64(20)) % np.uint64(size)).astype(np.int64))
            what.append(place[counted])
        when, where, what = (np.concatenate(x) for x in (when, where, what))
        least = np.full(n * size, np.inf)
        np.minimum.at(least, where, when)
        first = when == least[where]
        flat = np.zeros(n * size, np.uint64)
        flat[where[first]] = what[first]
        full = np.isfinite(least.reshape(n, size)).all(axis=1) & open_texts
        out[full] = flat.reshape(n, size)[full]
        open_texts &= ~full
        limit = limit * 2
    return out


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Two bits of every slot, 32 slots in a 64-bit integer."""
    n, size = signatures.shape
    two = np.zeros((n, -(-size // 32) * 32), np.uint64)
    two[:, :size] = signatures & np.uint64(3)
    return np.bitwise_or.reduce(two.reshape(n, -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2).view(np.int64)


def alike(x: str, y: str, size: int, threshold: float) -> F.Column:
    """Whether the sketches of two sides differ in no more slots than a link's may."""
    p = threshold + (1 - threshold) / 4
    most = int((1 - p) * size + SLACK * (p * (1 - p) * size) ** 0.5)
    different = F.lit(0)
    for i in range(-(-size // 32)):
        d = F.col(f"sketch{i}_{x}").bitwiseXOR(F.col(f"sketch{i}_{y}"))
        different = different + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return different <= most


def parities(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each text, whether the number of its shingles in a cell is odd, 64 cells in an integer."""
    out = np.zeros(n * PARITY, np.uint64)
    odd = counts & 1 == 1
    cell = mix(hashes[odd]) % np.uint64(64 * PARITY)
    np.bitwise_xor.at(out, owner[odd] * PARITY + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return out.view(np.int64).reshape(n, PARITY)


def possible(x: str, y: str, threshold: float) -> F.Column:
    """Whether sizes and parities leave room for an overlap of ``threshold``; exact, a link always passes.

    With d shingles that only one of the texts has and s in both together the overlap is
    (s - d) / (s + d), and d is at least the number of cells that differ in parity.
    """
    differ = F.lit(0)
    for i in range(PARITY):
        differ = differ + F.bit_count(F.col(f"parity{i}_{x}").bitwiseXOR(F.col(f"parity{i}_{y}")))
    total_x, total_y = F.col(f"total_{x}"), F.col(f"total_{y}")
    room = (total_x + total_y) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(total_x - total_y) <= room) & (differ <= room)


def band_keys(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.int64]]:
    """The band keys of each text (none for a text without words), its sketch, parities and number of shingles."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.int64]] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        hashes, owner, counts = multiset(*shingles(texts[a:b]))
        signatures = bag_signatures(hashes, owner, counts, b - a, bands * rows)
        keys = np.zeros((b - a, bands), np.uint64)
        for i in range(rows):
            keys = mix(keys * np.uint64(31) + signatures[:, i::rows] + np.uint64(i))
        keys = mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        has = np.bincount(owner, minlength=b - a) > 0
        total = np.bincount(owner, counts, b - a).astype(np.int64)
        out += [(k if h else k[:0], x, y, t) for k, h, x, y, t in zip(keys, has, sketches(signatures), parities(hashes, owner, counts, b - a), total)]
        a = b
    return out


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (hashes, counts), sorted by hash."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def word_digest(text: F.Column) -> F.Column:
    """SHA-256 of the words with single blanks between."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")).cast("binary"), 256))


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = band_keys(batch["text"].tolist(), bands, rows)
            yield pd.DataFrame({"id": batch["id"], "digest": batch["digest"]} | {name: [x[i] for x in found] for i, name in enumerate(TRAITS)})

    text = F.coalesce(exact_col(text_col), F.lit(""))
    source = docs.select(exact_col(id_col).cast("string").alias("id"), word_digest(text).alias("digest"), text.alias("text"))
    return source.mapInPandas(run, "id string, digest binary, keys array<long>, sketch array<long>, parity array<long>, total long").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, scratch: list[str]) -> DataFrame:
    """Each pair (a, b) of digests with whether it is a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            linked = []
            for a, b, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                for key, text in ((a, s), (b, t)):
                    if key not in known:
                        if len(known) >= 256:
                            known.clear()
                        hashes, _, counts = multiset(*shingles([text]))
                        known[key] = (hashes, counts)
                    if a not in known:  # was cleared away for b
                        hashes, _, counts = multiset(*shingles([s]))
                        known[a] = (hashes, counts)
                linked.append(overlap(known[a], known[b]) >= threshold)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    named = lambda c: texts.select(F.col("digest").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    with session_conf(pairs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "200"}):
        return written(both.mapInPandas(run, "a binary, b binary, linked boolean"), "links", scratch)


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, label: the least node of its connected component.

    Alternating large-star and small-star steps; each one replaces the edges by edges to smaller
    nodes, and a logarithmic number of them leaves every node linked to its component's least one.
    """
    spark, scratch = edges.sparkSession, []
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", scratch)
    stamp = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = stamp(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u")
        small = small.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(low.select("u", F.col("least").alias("v"))).distinct()
        now = written(small, "edges", scratch)
        remove(spark, scratch.pop(0))
        after = stamp(now)
        if after == before:
            break
        before = after
    kind = edges.schema["u"].dataType
    empty = spark.createDataFrame([], "node string, label string").select(F.col("node").cast(kind), F.col("label").cast(kind))
    return empty if not before[0] else now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_docs and n_texts of the class."""
    spark, scratch = docs.sparkSession, []
    save = lambda df, what: written(df, what, scratch)
    signed = save(_signed(docs, id_col, text_col, bands, rows), "signatures")
    reps = save(signed.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in TRAITS)), "texts")
    ids = written(signed.select("id", "digest"), "ids")
    remove(spark, scratch.pop(0))
    keyed = reps.select("digest", F.explode("keys").alias("key"))
    members = save(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"), "buckets")
    mates = save(members.groupBy("digest").agg(F.sum("n").alias("mates")), "mates")
    hubs = members.join(mates, "digest").groupBy("key").agg(F.max(F.struct("mates", "digest")).alias("hub")).select("key", F.col("hub.digest").alias("hub"))
    text = F.coalesce(exact_col(text_col), F.lit(""))
    copies = save(docs.select(word_digest(text).alias("digest"), text.alias("text")).join(mates.hint("merge"), "digest", "left_semi"), "candidate-rows")
    texts = save(copies.groupBy("digest").agg(F.first("text").alias("text")), "candidate-texts")
    remove(spark, scratch.pop(-2))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edge = lambda df: df.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars = save(members.select("key", "digest").join(hubs, "key").filter("digest <> hub").select(*pair("digest", "hub")).distinct(), "stars")
    checked = _verified(stars, texts, threshold, scratch)
    labels = save(components(edge(checked)), "labels")
    labelled = members.select("key", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    words = [(c, i) for c, n in (("sketch", -(-bands * rows // 32)), ("parity", PARITY)) for i in range(n)]
    plain = [F.col(c)[i].alias(f"{c}{i}") for c, i in words]  # columns instead of arrays keep the join's code small enough to be compiled
    active = save(labelled.join(mixed, "key", "left_semi").join(reps.select("digest", "keys", "total", *plain), "digest"), "active")
    x, y = (active.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("digest", "label", "keys", "total", *(f"{c}{i}" for c, i in words)))) for side in "xy")
    apart = (x["key"] == y["key"]) & (F.col("digest_x") < F.col("digest_y")) & (F.col("label_x") != F.col("label_y"))
    first = F.array_intersect("keys_x", "keys_y")[0] == x["key"]  # a pair is formed in its first common bucket only
    close = x.join(y, apart & alike("x", "y", bands * rows, threshold) & possible("x", "y", threshold) & first)
    left = save(close.select(F.col("digest_x").alias("a"), F.col("digest_y").alias("b")), "pairs")
    labels = save(components(edge(_verified(left, texts, threshold, scratch)).unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))), "labels")
    classed = save(reps.select("digest", "id", "copies").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest")), "classed")
    classes = save(classed.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("n_docs"), F.count(F.lit(1)).alias("n_texts")), "classes")
    known = written(classed.select("digest", "label").join(classes, "label").drop("label"), "known")
    for path in scratch:
        remove(spark, path)
    return ids.withColumnRenamed("id", "doc_id").join(known, "digest").drop("digest")


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact: every pair of texts that shares a shingle, its multiset overlap, connected components.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
texts AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS rep, count(*) AS copies FROM split GROUP BY 1),
sh AS (SELECT rep, array_to_string(w[i:i+4], ' ') AS s, count(*) AS c
       FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0) GROUP BY ALL),
tot AS (SELECT rep, sum(c) AS n FROM sh GROUP BY rep),
pairs AS (SELECT x.rep AS a, y.rep AS b, sum(least(x.c, y.c)) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN tot ta ON ta.rep = a JOIN tot tb ON tb.rep = b WHERE m / (ta.n + tb.n - m) >= 0.8),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
label AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
sizes AS (SELECT class_id, sum(copies)::BIGINT AS n_docs, count(*) AS n_texts FROM label JOIN texts USING (rep) GROUP BY class_id)
SELECT doc_id, class_id, n_docs, n_texts
FROM split JOIN texts ON array_to_string(split.w, ' ') = t JOIN label USING (rep) JOIN sizes USING (class_id)
"""
