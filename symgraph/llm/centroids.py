"""Operator 11: clustering of vectors around centroids in exact integers, screened in float32.

A component x becomes the integer floor(256 * x).  For the assignment a float32 matrix product gives
every squared distance but for the vector's own norm; its rounding error is bounded by
gamma = m * u / (1 - m * u) times the product of the norms (u = 2^-24, m = components + 2, whatever the
order of summation), so each centroid has an interval that holds the true value.  Centroids whose interval
lies above the upper end of another one are out; where more than one is left, these are computed again in exact integers,
and the smaller number wins ties.  The distance to the winner is exact too.

Prepared vectors are written once: 16-bit integers where all components fit, else the components as
doubles, which are exact.  Vectors with an integer of 2^26 or more (less for over 256 components) are not screened but go through Python's
integers.  A round's tasks give for each centroid the number of its vectors and their sums, split into
limbs of 32 bits where a sum does not fit a long, so sums of any size are exact; Spark adds them up,
and only k * components numbers come to the driver, whatever the number of vectors.

Defined results: vectors with another number of components, a null or a component that is not finite are
left out; k is the number of kept vectors if there are fewer; a null id counts as empty text in the digest
that picks the first centroids, and equal digests are ordered by the vectors; repeated rows count as often as
they occur; a distance beyond a long is null, and so are the sums it is part of; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, remove, table, written

DIM, K, ROUNDS, SEED = 64, 40, 5, 2
SCALE = 256
LIMB = 32
_LONG = 1 << 63
Integers = list[list[int]]


def plain_below(dim: int) -> int:
    """Integers below this have exact distances in 64 bits."""
    return min(1 << 26, math.isqrt((1 << 62) // dim) // 2)


def integers(values: list[float]) -> list[int]:
    """floor(256 * x) of finite doubles of any size."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**45 else int(x) * SCALE for x in values]


def _packed(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore"):
                v = np.floor(x * SCALE)
            small = (np.abs(v) < 1 << 15).all(axis=1)
            data = [v[i].astype("<i2").tobytes() if s else x[i].astype("<f8").tobytes() for i, s in enumerate(small)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(data, pa.binary())], ["vec_id", "v"])

    return run


def prepared(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(vec_id, v): the kept vectors, packed."""
    x, finite = exact_col(vector_col).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = vectors.select(exact_col(id_col).alias("vec_id"), x.alias("x")).filter((F.size("x") == dim) & F.forall("x", finite))
    return kept.mapInArrow(_packed(dim), f"vec_id {vectors.schema[id_col].dataType.simpleString()}, v binary")


def unpacked(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Rows of plain vectors, their integers (n, dim), and (row, integers) of the larger ones."""
    data = column.to_pylist()
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    limit = plain_below(dim)
    short, plain, large, wide = np.flatnonzero(sizes == 2 * dim), [], [], []
    v = np.frombuffer(b"".join([data[i] for i in short]), "<i2").astype(np.int64).reshape(-1, dim)
    for i in np.flatnonzero(sizes != 2 * dim).tolist():
        whole = integers(np.frombuffer(data[i], "<f8").tolist())
        if max(map(abs, whole)) < limit:
            plain.append(i)
            wide.append(whole)
        else:
            large.append((i, whole))
    rows = np.concatenate([short, np.array(plain, np.int64)])
    return rows, np.concatenate([v, np.array(wide, np.int64).reshape(-1, dim)]), large


def exact_nearest(v: list[int], centroids: Integers) -> tuple[int, int]:
    """(number, squared distance) of the nearest centroid by Python's integers."""
    return min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))[::-1]


def screened(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), n x k: float32 bounds of each squared distance less the vector's own squared norm."""
    m = v.shape[1] + 2
    gamma = m * 2.0**-24 / (1 - m * 2.0**-24)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (v.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    own, norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), (centroids.astype(np.float64) ** 2).sum(axis=1)
    value = norms - 2 * product
    # the norms and this difference are rounded in double precision: a thousand of its units cover that
    error = 2 * gamma * own[:, None] * np.sqrt(norms) * (1 + 1e-9) + (norms + 2 * np.abs(product)) * 1000 * 2.0**-53
    return value - error, value + error


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of plain vectors (n, dim); ties: the smaller number."""
    low, high = screened(v, centroids)
    left = low <= high.min(axis=1)[:, None]
    best = left.argmax(axis=1)
    row, number = np.nonzero(left & (left.sum(axis=1) > 1)[:, None])
    if len(row):
        far = ((v[row] - centroids[number]) ** 2).sum(axis=1)
        order = np.lexsort((number, far, row))
        first = np.unique(row[order], return_index=True)
        best[first[0]] = number[order][first[1]]
    return best, ((v - centroids[best]) ** 2).sum(axis=1)


def assigned(column: pa.Array, centroids: Integers, dim: int) -> tuple[np.ndarray, list[int], tuple, list]:
    """Cluster and distance of every row, and the rows as :func:`unpacked` gives them."""
    rows, v, large = unpacked(column, dim)
    cluster, distance = np.zeros(len(column), np.int64), [0] * len(column)
    if max((abs(x) for c in centroids for x in c), default=0) < plain_below(dim):
        found, far = nearest(v, np.array(centroids, np.int64).reshape(-1, dim)) if len(v) else (np.zeros(0, np.int64),) * 2
        cluster[rows] = found
        for i, d in zip(rows.tolist(), far.tolist()):
            distance[i] = d
        rest = large
    else:
        rest = [*zip(rows.tolist(), v.tolist()), *large]
    for i, whole in rest:
        cluster[i], distance[i] = exact_nearest(whole, centroids)
    return cluster, distance, (rows, v), large


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value): value * 2^(32 * place) add up to ``total``; one entry where it is a long with room to spare."""
    if abs(total) < 1 << 62:
        yield 0, total
        return
    sign, total, place = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield place, sign * (total & (1 << LIMB) - 1)
        total, place = total >> LIMB, place + 1


def _sums(centroids: Integers, dim: int) -> Callable:
    """Of a partition, for each centroid: (cluster, place, component, total); component -1 has the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), object)
        for batch in batches:
            cluster, _, (rows, v), large = assigned(batch.column("v"), centroids, dim)
            counts += np.bincount(cluster, minlength=len(centroids))
            own = cluster[rows]
            order = np.argsort(own, kind="stable")
            found, first = np.unique(own[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(v[order], first, axis=0).astype(object)
            for i, whole in large:
                sums[cluster[i]] += np.array(whole, object)
        out = [(j, 0, -1, int(n)) for j, n in enumerate(counts) if n]
        out += [(j, place, i, part) for j, n in enumerate(counts) if n for i, total in enumerate(sums[j]) for place, part in _limbs(int(total))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "component", "total"])

    return run


def moved(vectors: DataFrame, centroids: Integers) -> Integers:
    """The centroids after one round: each the floor of the mean of its vectors; one without vectors stays."""
    dim = len(centroids[0])
    parts = vectors.select("v").mapInArrow(_sums(centroids, dim), "cluster int, place int, component int, total long")
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    for r in parts.groupBy("cluster", "place", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k * components * limbs numbers
        if r.component < 0:
            counts[r.cluster] = int(r.total)
        else:
            sums[r.cluster][r.component] += int(r.total) << LIMB * r.place
    return [[s // n for s in row] if n else old for n, row, old in zip(counts, sums, centroids)]


def started(vectors: DataFrame, k: int, dim: int, seed: int) -> Integers:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(text.cast("binary"), 256), F.hex("v")).limit(k).collect()
    return [np.frombuffer(r.v, "<i2").tolist() if len(r.v) == 2 * dim else integers(np.frombuffer(r.v, "<f8").tolist()) for r in rows]


def total_of(column: str) -> Column:
    """Exact sum of longs; null where it does not fit or a part is null."""
    whole = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(F.count(column) == F.count(F.lit(1)), whole.try_cast("long"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, Integers]:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; and the centroids."""
    spark, scratch = vectors.sparkSession, []
    ready = written(prepared(vectors, id_col, vector_col, dim), "centroid-vectors", scratch)
    centroids = started(ready, k, dim, seed)
    kind = ready.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return ready.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"), []
    for _ in range(rounds):
        centroids = moved(ready, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _, _ = assigned(batch.column("v"), centroids, dim)
            fits = pa.array([d if d < _LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), fits], ["vec_id", "cluster", "distance"])

    found = written(ready.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "centroid-rows")
    for path in scratch:
        remove(spark, path)
    by_cluster = {r.cluster: r.total for r in found.groupBy("cluster").agg(total_of("distance").alias("total")).collect()}  # k rows at most
    inertia = None if None in by_cluster.values() or sum(by_cluster.values()) >= _LONG else sum(by_cluster.values())
    known = [(j, total, inertia, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, total in by_cluster.items()]
    names = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after five rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _round(r: int) -> str:
    return f"""
d{r} AS MATERIALIZED (SELECT vec_id, min(d * 64 + c) AS best FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM e JOIN c{r} USING (i) GROUP BY vec_id, c) GROUP BY vec_id),
n{r} AS (SELECT (best % 64)::INTEGER AS c, i, floor(sum(x) / count(*))::BIGINT AS y FROM d{r} JOIN e USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.i, coalesce(n{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN n{r} ON n{r}.c = c{r}.c AND n{r}.i = c{r}.i),"""


#: Every distance of every round; ids are taken as unique and never null.
SQL = (
    """
WITH kept AS (SELECT vec_id, embedding AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT vec_id, i, floor(256 * x::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM kept)),
s AS (SELECT vec_id, (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM s JOIN e USING (vec_id) WHERE c < 40),"""
    + "".join(_round(r) for r in range(ROUNDS))
    + f"""
z AS (SELECT vec_id, min(d * 64 + c) AS best FROM (SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM e JOIN c{ROUNDS} USING (i) GROUP BY vec_id, c) GROUP BY vec_id),
f AS (SELECT vec_id, (best % 64)::INTEGER AS cluster, (best // 64)::BIGINT AS distance FROM z),
h AS (SELECT c AS cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM f JOIN h USING (cluster)
"""
)
