"""Operator 9: winnowing fingerprints with positions.

Rolling hashes of all k-grams of code points; of every window of w consecutive grams the smallest
hash is taken, of equal ones the rightmost.  Any passage of at least w + k - 1 code points that two
texts share therefore gives a common fingerprint (the match guarantee), and none shorter than k
does.  A fingerprint is the list of (hash, position); as a string each entry is 18 hexadecimal
digits: 10 of the 40-bit hash, 8 of the position.

Hashes come from prefix sums modulo 2^64 over many texts at a time, window minima from block-wise
running minima, so no Python loop runs over code points.  Texts of any length go through in
overlapping pieces; that changes nothing, because a window's choice depends on the window alone.

Defined results: null text counts as empty; an empty text has an empty fingerprint; a text shorter
than k has one entry, its whole; one with fewer than w grams has the minimum of these; likeness is
the Jaccard similarity of the hash sets, 1 for two empty ones; rows with equal ids are ordered by a
hash of their texts; a null id comes first; ids that are no integers are refused (TypeError); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ordered import id_ranges

GRAM, WINDOW = 10, 12
#: Code points that are worked on at a time, and those of one piece of a longer text (below 2^24).
CHUNK, PIECE = 500_000, 2_000_000
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for the next call."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        kept = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * CHUNK), base, np.uint64))])
        _powers[str(base)] = kept
    return kept[:n]


def _selected(texts: list[str], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n == 0:
        return [none] * len(texts)
    inverse = _power(pow(_BASE, -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    keys = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if n >= k:
        keys[: n - k + 1] = _mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    keys[starts[short]] = _mix((sums[ends[short]] - sums[starts[short]]) * inverse[starts[short]] + sizes[short].astype(np.uint64))
    keys = keys & ~_LOW | (_LOW - np.arange(n, dtype=np.uint64))
    grams = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    windows = np.maximum(grams - w + 1, 0)  # full windows of each text
    padded = np.full(-(-(n + w) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    chosen = [lowest[first]]
    few = np.flatnonzero((grams > 0) & (grams < w))
    if few.size:
        bounds = np.stack([starts[few], starts[few] + grams[few]], 1).ravel()
        chosen.append(np.minimum.reduceat(np.append(keys, np.uint64(0)), bounds)[::2])
    chosen = np.concatenate(chosen)
    at = (_LOW - (chosen & _LOW)).astype(np.int64)
    at, where = np.unique(at, return_index=True)
    hashes = chosen[where] >> np.uint64(24)
    cut = np.searchsorted(at, np.concatenate([starts, [n]]))
    return [(hashes[a:b], at[a:b] - s) for a, b, s in zip(cut[:-1], cut[1:], starts)]


def fingerprints(texts: list[str], k: int = GRAM, w: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, by position."""
    out: list = [None] * len(texts)
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            parts = []
            for s in range(0, len(text) - k - w + 2, PIECE):
                hashes, at = _selected([text[s : s + PIECE - 1 + w + k - 1]], k, w)[0]
                parts.append((hashes, at + s))
            at, where = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
            out[i] = (np.concatenate([p[0] for p in parts])[where], at)
            continue
        group.append(i)
        size += len(text)
        if size >= CHUNK:
            for j, found in zip(group, _selected([texts[j] for j in group], k, w)):
                out[j] = found
            group, size = [], 0
    for j, found in zip(group, _selected([texts[j] for j in group], k, w)):
        out[j] = found
    return out


def as_string(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    hashes, at = fingerprint
    records = np.zeros((len(hashes), 9), np.uint8)
    records[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    records[:, 5:] = at.astype(">u4").view(np.uint8).reshape(-1, 4)
    return records.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_column(k: int = GRAM, w: int = WINDOW):
    """A pandas UDF: text -> fingerprint string, for any column of texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([as_string(x) for x in fingerprints([t or "" for t in texts], k, w)], dtype=object)

    return run


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in parts of ascending ids, each part followed by a copy of the next part's first row.

    ``role`` is 0 for a part's own rows and 1 for that copy; the last part gets the very first row.
    """
    rows, borders = id_ranges(docs, id_col, text_col)
    last = len(borders) - 1
    firsts = rows.sparkSession.createDataFrame([(b, i - 1 if i else last) for i, b in enumerate(borders)], "key long, copy_to int")
    copies = F.broadcast(firsts)  # one row a part
    dealt = rows.join(copies, "key", "left").withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("role")), F.when(F.col("copy_to").isNotNull(), F.struct(F.col("copy_to").alias("part"), F.lit(1).alias("role")))))))
    dealt = dealt.select("id", "key", "text", "to.part", "to.role").withColumn("tie", F.xxhash64("text"))
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "role", "key", "tie")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[str | None, str]] = []  # rows whose next text has not come yet: only the last

        def work(pairs: list[tuple[str | None, str, str]]) -> pd.DataFrame:
            changed = [edited(t, nxt) for _, t, nxt in pairs]
            found = fingerprints([*(t for _, t, _ in pairs), pairs[-1][2], *changed], k, w)
            own, other = found[: len(pairs) + 1], found[len(pairs) + 1 :]
            sets, other_sets = [np.unique(x[0]) for x in own], [np.unique(x[0]) for x in other]
            return pd.DataFrame(
                [(doc_id, len(t), hashlib.sha256(c.encode()).hexdigest(), as_string(a), as_string(b), likeness(s, e), likeness(s, following)) for (doc_id, t, _), c, a, b, s, e, following in zip(pairs, changed, own, other, sets, other_sets, sets[1:])],
                columns=columns,
            )

        pairs: list[tuple[str | None, str, str]] = []
        size, copied = 0, -1
        for batch in batches:
            for doc_id, text, part, role in zip(batch["id"], batch["text"], batch["part"], batch["role"]):
                if role == 1 and copied == part:
                    continue  # more rows with the id of the first one
                if waiting:
                    pairs.append((*waiting.pop(), text))
                    size += 2 * len(pairs[-1][1])
                if role == 1:
                    copied = part
                else:
                    waiting.append((doc_id, text))
                if pairs and (size >= 2 * CHUNK or role == 1):
                    yield work(pairs)
                    pairs, size = [], 0

    rows = with_next(docs, id_col, text_col).select(F.col("id").cast("string"), "text", "part", "role")
    return rows.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their successors."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
