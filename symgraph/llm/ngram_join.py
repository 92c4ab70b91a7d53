"""Operator 12: exact Jaccard join of word 5-gram sets by token-combination prefixes.

A document is the set of its five-word shingles; two documents link when 100 * intersection is at least
``percent`` * union.  Rows whose words are equal are one text from the start.

Tokens (shingles) are put in one order for all texts, rarest first.  A link leaves at most n - o
of a text's n tokens outside the other one, o = ceil(percent * n / 100).  Rare tokens are a class of their
own, each indexed alone; those in more than ``LIMITS`` texts are in class 2 or 3, which is dealt into parts by
a hash, and what is indexed are combinations of two or three tokens of a part.  Taking away n - o
tokens cannot empty every part of a prefix whose parts have, in all, a surplus (tokens - class + 1) of n - o + 1;
so the prefix is extended until it has that, and two texts that link share an indexed entry.  The
number of parts follows the size, so texts are indexed once for each doubling of sizes in which a
partner can be the smaller one.

Most texts have no partner.  They are found before with the same lemma in the order of the tokens' hashes:
of the first n - o + L tokens at least L must occur in another text's first tokens.  Only what is left
is counted and indexed as a whole.

Not all pairs of an entry are verified: first each text is compared with the entry's hub and
the links become components, then pairs of different components whose sizes and parities (see
:mod:`bag_minhash`) leave room for a link.  Every verification is exact on the whole sets of 64-bit hashes.
So no link between components is lost and thousands of near copies cost one comparison each.

Defined results: null text counts as empty; a text without words has an empty set and links with nothing,
equal texts of that kind included; one to four words are one shingle; repeated rows are linked copies;
a null id is never a component's id unless all its ids are null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bag_minhash import PARITY, components, parities, possible
from .common import exact_col, remove, session_conf, table, written
from .wordhash import mix, multiset, shingles

PERCENT = 80
#: Texts with a token above which it is of class 2 and of class 3.
LIMITS = (32, 1024)
#: Tokens of a size band's smallest text for each part of a class.
PART = 16
#: Code points that are worked on at a time.
CHUNK = 400_000
#: Bits of the filter of digests, at any size (a full one filters nothing, and nothing is lost).
BITS = 1 << 22


def overlap_needed(n: int, percent: int = PERCENT) -> int:
    """The tokens of n that a link has in common at least."""
    return -(-percent * n // 100)


def spare(n: int, percent: int = PERCENT) -> int:
    """L: tokens of the hash-ordered prefix that must occur elsewhere, beyond the n - o that may be missing."""
    return max(1, -(-n // 20))


def head_size(n: int, percent: int = PERCENT) -> int:
    return min(n, n - overlap_needed(n, percent) + spare(n, percent))


def normalised(text: str | None) -> bytes:
    """Lower-case (A-Z only) words with single blanks between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def places(digests: list[bytes], filter_bits: int) -> np.ndarray:
    """The bit of each digest in the filter."""
    return (np.frombuffer(b"".join(digests), "<u8")[::2] % np.uint64(filter_bits)).astype(np.int64)


def token_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): the tokens of text i, ascending, are tokens[bounds[i]:bounds[i+1]]."""
    parts, sizes, a = [], [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        tokens, owner, _ = multiset(*shingles([t.decode("utf-8", "surrogatepass") for t in texts[a:b]]))
        parts.append(tokens)
        sizes.append(np.bincount(owner, minlength=b - a))
        a = b
    bounds = np.concatenate([[0], *sizes]).cumsum().astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), bounds


def bands(n: int, percent: int = PERCENT) -> range:
    """Doublings of sizes that have a possible partner of n tokens as the smaller one, n itself included."""
    return range(overlap_needed(n, percent).bit_length() - 1, n.bit_length())


def parts_of(band: int, percent: int = PERCENT) -> int:
    """Parts of a class for texts of a band; 0 if combinations could not be enough, so that all tokens are indexed alone."""
    parts = max(1, (1 << band) // PART)
    return parts if 3 * parts <= overlap_needed(1 << band, percent) - 1 else 0


def entries(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, limits: tuple[int, int] = LIMITS) -> np.ndarray:
    """What a text of n tokens is indexed by; given are its tokens that other texts have too, with the number of texts."""
    short = n - overlap_needed(n, percent) + 1 - (n - len(tokens))
    if short <= 0:  # the tokens that no other text has are a prefix that is long enough
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, counts))
    ranked = list(zip(tokens[order].tolist(), (1 + np.searchsorted(limits, counts[order], side="left")).tolist()))
    found: list[tuple[int, int, int]] = []
    for band in bands(n, percent):
        parts, left = parts_of(band, percent), short
        held: dict[tuple[int, int], list[int]] = {}
        for token, kind in ranked:
            if kind == 1 or not parts:
                found.append((token, 0, 0))
                left -= 1
            else:
                mates = held.setdefault((kind, (token >> 20) % parts), [])
                if len(mates) >= kind - 1:
                    found += [(*sorted((token, *c)), *(0,) * (3 - kind)) for c in itertools.combinations(mates, kind - 1)]
                    left -= 1
                mates.append(token)
            if left == 0:
                break
        assert left == 0, "parts_of leaves every prefix long enough"
    key = np.array(found, np.uint64).reshape(-1, 3)
    return np.unique(mix(mix(mix(key[:, 0]) + key[:, 1] * np.uint64(0x9E3779B97F4A7C15)) + key[:, 2] * np.uint64(0xC2B2AE3D27D4EB4F)))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [normalised(t) for t in batch.column("text").to_pylist()]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _heads(batches: Iterator[pa.RecordBatch], percent: int, filter_bits: int) -> Iterator[pa.RecordBatch]:
    """Of each text with words: id, digest, n and the first tokens by hash."""
    for batch in batches:
        texts = _texts(batch)
        kept = [i for i, t in enumerate(texts) if t]
        texts = [texts[i] for i in kept]
        tokens, bounds = token_sets(texts)
        n = np.diff(bounds)
        size = np.array([head_size(int(x), percent) for x in n], np.int64)
        ends = np.concatenate([[0], size.cumsum()])
        index = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], size)
        keys = [digest(t) for t in texts]
        columns = {"id": batch.column("id").take(pa.array(kept, pa.int64())), "digest": pa.array(keys, pa.binary()), "place": pa.array(places(keys, filter_bits)), "n": pa.array(n, pa.int64()), "head": _lists(tokens[index], ends)}
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(digest, tokens, parity) of the texts whose digest the filter lets through."""
    for batch in batches:
        texts = [(digest(t), t) for t in _texts(batch) if t]
        place = places([d for d, _ in texts], 64 * len(bits))
        through = bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
        texts = [t for t, x in zip(texts, through) if x]
        tokens, bounds = token_sets([t for _, t in texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        parity = parities(tokens, owner, np.ones(len(tokens), np.int64), len(texts))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.binary()), _lists(tokens, bounds), _lists(parity.reshape(-1), np.arange(len(texts) + 1) * PARITY)], ["digest", "tokens", "parity"])


def _filter_of(texts: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit for the digest of each text."""
    words = texts.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
    out = np.zeros(filter_bits // 64, np.int64)
    for r in words.collect():  # filter_bits / 64 rows at most
        out[r.word] = r.bits
    return out.view(np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """Each pair (a, b) of texts with whether it is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    named = lambda c: sets.select(F.col("rep").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "tokens_a", "tokens_b")
    with session_conf(pairs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "200"}):
        return written(both.mapInArrow(run, "a long, b long, linked boolean"), "links", scratch)


def _active(reps: DataFrame, percent: int) -> DataFrame:
    """The texts of which enough first tokens occur among those of another text."""
    tokens = reps.select("rep", F.explode("head").alias("token"))
    repeated = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").select("token")
    shared = tokens.join(repeated, "token", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    smallest = F.ceil(F.col("n") * percent / 100)  # of a partner, whose L counts
    need = F.greatest(F.lit(1), F.ceil(smallest / 20))
    return reps.drop("head").join(shared, "rep").filter(F.col("shared") >= need).drop("shared")


def _indexed(sets: DataFrame, percent: int, limits: tuple[int, int]) -> DataFrame:
    """(rep, key): the entries of every text."""
    tokens = sets.select("rep", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    known = tokens.join(counts, "token").groupBy("rep").agg(F.collect_list(F.struct("token", "n_texts")).alias("found"))  # no more than a text's own tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for n, found in zip(batch["n"], batch["found"]):
                token, count = (np.array([r[c] for r in found], np.int64) for c in ("token", "n_texts"))
                keys.append(entries(int(n), token.view(np.uint64), count, percent, limits).view(np.int64))
            yield pd.DataFrame({"rep": batch["rep"], "keys": keys})

    with_n = known.join(sets.select("rep", "n"), "rep")
    return with_n.select("rep", "n", "found").mapInPandas(run, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and digest of every row (null without words)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([digest(t) if t else None for t in _texts(batch)], pa.binary())], ["id", "digest"])


def links_between(keyed: DataFrame, sets: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """(node, label) of the components of texts that links of the indexed pairs (rep, key) join; texts without links have no row."""
    save = lambda df, what: written(df, what, scratch)
    members = save(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1"), "key"), "ngram-entries")
    sizes = sets.select("rep", "n", *(F.col("parity")[i].alias(f"parity{i}") for i in range(PARITY)))
    mates = members.groupBy("rep").agg(F.sum("n_texts").alias("mates"))
    hubs = members.join(mates, "rep").groupBy("key").agg(F.max(F.struct("mates", "rep")).alias("hub")).select("key", F.col("hub.rep").alias("hub"))
    pairs = members.select("key", "rep").join(hubs, "key").filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    fits = (100 * F.least("total_x", "total_y") >= percent * F.greatest("total_x", "total_y")) & possible("x", "y", percent / 100)
    side = lambda df, s: df.select(*(F.col(c).alias(f"{'total' if c == 'n' else c}_{s}") for c in df.columns if c != "key"), *("key" for c in df.columns if c == "key"))
    x, y = side(sizes, "x"), side(sizes, "y")
    stars = save(pairs.join(x, F.col("a") == F.col("rep_x")).join(y, F.col("b") == F.col("rep_y")).filter(fits).select("a", "b"), "ngram-stars")
    edge = lambda df: df.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = save(components(edge(_verified(stars, sets, percent, scratch))), "ngram-labels")
    labelled = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    apart = save(labelled.join(mixed, "key", "left_semi").join(sizes, "rep"), "ngram-mixed")
    x, y = side(apart, "x").withColumnRenamed("key", "key_x"), side(apart, "y").withColumnRenamed("key", "key_y")
    close = x.join(y, (F.col("key_x") == F.col("key_y")) & (F.col("rep_x") < F.col("rep_y")) & (F.col("label_x") != F.col("label_y")) & fits)
    rest = save(close.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct(), "ngram-pairs")
    return components(edge(_verified(rest, sets, percent, scratch)).unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, limits: tuple[int, int] = LIMITS, filter_bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (least id reachable by links)."""
    spark, scratch = docs.sparkSession, []
    save = lambda df, what: written(df, what, scratch)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(exact_col(id_col).alias("id"), exact_col(text_col).alias("text"))
    heads = rows.mapInArrow(lambda batches: _heads(batches, percent, filter_bits), f"id {kind}, digest binary, place long, n long, head array<long>")
    grouped = heads.groupBy("digest").agg(F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in ("place", "n", "head")))
    reps = save(grouped.withColumn("rep", F.monotonically_increasing_id()), "ngram-texts")
    active = save(_active(reps, percent), "ngram-active")
    known = save(reps.select("rep", "digest", "first_id", "n"), "ngram-names")
    remove(spark, scratch.pop(0))
    bits = _filter_of(active, filter_bits)
    found = rows.select("text").mapInArrow(lambda batches: _sets(batches, bits), "digest binary, tokens array<long>, parity array<long>")
    sets = save(found.groupBy("digest").agg(F.first("tokens").alias("tokens"), F.first("parity").alias("parity")).join(active.select("digest", "rep", "n"), "digest").drop("digest"), "ngram-sets")
    keyed = save(_indexed(sets, percent, limits), "ngram-keys")
    labels = save(links_between(keyed, sets, percent, scratch), "ngram-labels")
    labelled = save(known.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "ngram-labelled")
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = written(labelled.join(least, "label").select("digest", "n", "component_id"), "ngram-components")
    for path in scratch:
        remove(spark, path)
    ids = rows.mapInArrow(_named, f"id {kind}, digest binary")
    joined = ids.join(named, "digest", "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Exact: every pair of word sequences that shares a shingle, its overlap, connected components.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
texts AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS rep FROM split WHERE len(w) > 0 GROUP BY 1),
sh AS (SELECT DISTINCT rep, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts)),
tot AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
pairs AS (SELECT x.rep AS a, y.rep AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN tot ta ON ta.rep = a JOIN tot tb ON tb.rep = b WHERE 100 * m >= 80 * (ta.n + tb.n - m)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
label AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(tot.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM split LEFT JOIN texts ON array_to_string(split.w, ' ') = t AND len(split.w) > 0 LEFT JOIN label USING (rep) LEFT JOIN tot USING (rep)
"""
