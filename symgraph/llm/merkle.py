"""Operator 13: a Merkle manifest of a dataset, with an authentication path for every row.

Rows are leaves.  Within a group (a source) they ascend by id, and runs of ``FAN`` nodes become the
digest of their texts until one node, the subroot, is left; the subroots, ordered by group, become
the root in the same way.  Digests are lowercase hexadecimal SHA-256.

Positions come from one range sort by (group, id) and running counts over its partitions, so a group
with a third of all rows is spread over as many tasks as its rows need.  Nodes are then dealt into aligned blocks
of ``FAN ** DEPTH`` (4096), each worked off in one go.  A first pass over the blocks gives their
digests alone, which are the nodes of the next round, until a group has one.  On the way back each
block gets the path of its own node as a header row, and a traversal goes over its leaves: at every
level a treehash stack takes one leaf for each leaf that is passed, so that the next run of nodes is
ready when the path needs it.  Beside the block's leaf digests only two runs a level are held, so
memory grows with the logarithm of the block; the part of the path above the block is shared by its leaves.

Defined results: a null column counts as ``-``; other types than strings are cast to text; null
groups and null ids come first; rows of a group with equal ids are ordered by their digests, so repeated
rows are leaves side by side; a group's lone leaf is its subroot and a lone subroot is the root; an
empty table gives an empty result; columns that are not asked for are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, exact_col, remove, table, written

FAN, DEPTH = 16, 3
HEX = 64
#: Rows of a traversal that go back to Spark at a time (a row's path has some kilobytes).
PIECE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = {"siblings": "string", "places": "array<int>", "sizes": "array<int>"}


def combined(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def levels(n: int, fan: int = FAN) -> int:
    """How often n nodes are combined until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


class Treehash:
    """The nodes of one level, made leaf by leaf; ``run`` holds those of the run being built."""

    def __init__(self, level: int, fan: int) -> None:
        self.level, self.fan, self.run = level, fan, []
        self.stack: list[list[str]] = [[] for _ in range(level)]

    def _push(self, height: int, node: str) -> None:
        while height < self.level:
            waiting = self.stack[height]
            waiting.append(node)
            if len(waiting) < self.fan:
                return
            node, self.stack[height] = combined(waiting), []
            height += 1
        self.run.append(node)

    def take(self, leaf: str) -> None:
        self._push(0, leaf)

    def close(self) -> None:
        """No leaf comes any more: runs that are not full become nodes."""
        for height in range(self.level):
            if self.stack[height]:
                node, self.stack[height] = combined(self.stack[height]), []
                self._push(height + 1, node)


def block_digest(leaves: list[str], depth: int, fan: int = FAN) -> str:
    """The node that the leaves of a block become after ``depth`` levels."""
    tree = Treehash(depth, fan)
    for leaf in leaves:
        tree.take(leaf)
    tree.close()
    return tree.run[0]


def traverse(leaves: list[str], depth: int, fan: int = FAN, above: str = "") -> Iterator[tuple[str, list[int], list[int]]]:
    """For each leaf the texts of its siblings, level by level up to the block's node and then ``above``; its places in its runs; their sizes."""
    n = len(leaves)
    trees, now, fed = [Treehash(h, fan) for h in range(depth)], [], []
    for h, tree in enumerate(trees):  # the first run of every level
        span = min(fan ** (h + 1), n)
        for leaf in leaves[:span]:
            tree.take(leaf)
        if span == n:
            tree.close()
        now.append(tree.run)
        tree.run = []
        fed.append(span)
    above_here = [""] * depth + [above]
    for i in range(n):
        for h in range(depth - 1, -1, -1):
            at, rest = divmod(i, fan**h)
            if rest == 0:
                place = at % fan
                if i and place == 0:
                    now[h], trees[h].run = trees[h].run, []
                above_here[h] = "".join(now[h][:place]) + "".join(now[h][place + 1 :]) + above_here[h + 1]
        yield above_here[0], [i // fan**h % fan for h in range(depth)], [len(run) for run in now]
        for h in range(depth):
            if fed[h] < n:
                trees[h].take(leaves[fed[h]])
                fed[h] += 1
                if fed[h] == n:
                    trees[h].close()


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of values, each `-` if null, else its UTF-8 length, a colon and the text."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)).cast("binary"), 256)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def positions(rows: DataFrame, order: list[str], scratch: list[str]) -> DataFrame:
    """``rows`` (grp, ...) with pos, their place in their group by ``order``, and n, the group's size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), 0
        for batch in batches:
            row = []
            for grp, same in itertools.groupby(batch.column("grp").to_pylist()):
                n = len(list(same))
                seen = seen if grp == last else 0
                row += range(seen, seen + n)
                last, seen = grp, seen + n
            yield batch.append_column("row", pa.array(row, pa.int64()))

    kinds = ", ".join(f"`{c}` {k}" for c, k in dealt.dtypes)
    numbered = written(dealt.mapInArrow(number, f"{kinds}, row long"), "merkle-ranges", scratch)
    counts = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n_here"))
    before, whole = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("grp")
    shift = counts.select(F.col("grp").alias("grp_"), F.col("part").alias("part_"), F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("first"), F.sum("n_here").over(whole).alias("n"))
    placed = numbered.join(shift, F.col("part").eqNullSafe(F.col("part_")) & F.col("grp").eqNullSafe(F.col("grp_")))
    return placed.withColumn("pos", F.col("first") + F.col("row")).drop("grp_", "part_", "part", "row", "first")


def _blocks(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """nodes (grp, pos, n, digest) sorted and dealt by block: each block is whole in one partition."""
    return nodes.withColumn("block", F.floor(F.col("pos") / fan**depth).cast("long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after the other, from batches sorted by (grp, block)."""
    held, key = [], None
    for batch in batches:
        at = 0
        for this, same in itertools.groupby(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist())):
            n = len(list(same))
            if held and this != key:
                yield pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield pa.Table.from_batches(held)


def _above(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """The nodes of the next round: (grp, pos, n, digest) of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            n, leaves = rows["n"][0].as_py(), rows["digest"].to_pylist()
            node = {"n": [-(-n // fan**depth)], "digest": [block_digest(leaves, min(depth, levels(n, fan)), fan)]}
            yield from pa.table({"grp": rows["grp"][:1], "pos": rows["block"][:1]} | node).to_batches()

    dealt = _blocks(nodes.select("grp", "pos", "n", "digest"), fan, depth).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    kind = nodes.schema["grp"].dataType.simpleString()
    return dealt.mapInArrow(run, f"grp {kind}, pos long, n long, digest string")


def _paths(nodes: DataFrame, headers: DataFrame, fan: int, depth: int) -> DataFrame:
    """nodes (grp, pos, n, digest, key...) with siblings and places; headers: (grp, block, siblings, places, sizes) of each block's node."""
    kind = dict(nodes.dtypes)
    keys = [c for c in nodes.columns if c not in ("grp", "pos", "n", "digest")]
    out = ", ".join(f"`{c}` {k}" for c, k in [*((c, kind[c]) for c in ("grp", "pos", "digest", *keys)), *_PATH.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            head, own = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
            path = traverse(own["digest"].to_pylist(), min(depth, levels(own["n"][0].as_py(), fan)), fan, head["siblings"])
            for a in range(0, len(own), PIECE):
                piece = own.slice(a, PIECE)
                siblings, places, sizes = zip(*itertools.islice(path, len(piece)))
                found = (pa.array(siblings, pa.string()), *(pa.array([[*x, *head[c]] for x in own_part], pa.list_(pa.int32())) for c, own_part in (("places", places), ("sizes", sizes))))
                yield from pa.table({c: piece[c] for c in ("grp", "pos", "digest", *keys)} | dict(zip(_PATH, found))).combine_chunks().to_batches()

    rows = _blocks(nodes, fan, depth).withColumns({c: F.lit(None).cast(k) for c, k in _PATH.items()})
    both = rows.unionByName(headers.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(run, out)


def _climb(nodes: DataFrame, fan: int, depth: int, scratch: list[str]) -> list[DataFrame]:
    """The nodes of every round, the given ones first, until each group has one."""
    rounds = [nodes]
    while (most := rounds[-1].agg(F.max("n")).first()[0]) and most > 1:
        rounds.append(written(_above(rounds[-1].filter("n > 1"), fan, depth).unionByName(rounds[-1].filter("n = 1").select("grp", "pos", "n", "digest")), "merkle-nodes", scratch))
    return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame, fan: int, depth: int) -> DataFrame:
    """(grp, block, siblings, places, sizes) of each block of the first round; tops: (grp, siblings, places, sizes) of each group's last node."""
    headers = tops.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:]):
        headers = _paths(nodes, headers, fan, depth).select("grp", F.col("pos").alias("block"), *_PATH)
    return headers


def manifest(rows: DataFrame, group_col: str = "source", id_col: str = "doc_id", columns: list[str] | None = None, extra: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per row: grp, id, pos, leaf, subroot, root, siblings, places and sizes (and ``extra``, under its names).

    ``siblings`` is the text of all siblings, level by level from the leaf to the root and left to
    right in each; ``places`` and ``sizes`` have for each level the node's place in its run and the run's size.
    """
    spark, scratch = rows.sparkSession, []
    columns, extra = columns or rows.columns, extra or {}
    leaves = rows.select(exact_col(group_col).alias("grp"), exact_col(id_col).alias("id"), leaf_digest([exact_col(c) for c in columns]).alias("digest"), *(c.alias(f"extra_{name}") for name, c in extra.items()))
    nodes = written(positions(leaves, ["id", "digest"], scratch), "merkle-leaves")
    remove(spark, scratch.pop())
    rounds = _climb(nodes, fan, depth, scratch)
    subroots = positions(rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("group"), "digest"), ["group"], scratch)
    upper = _climb(written(subroots, "merkle-subroots", scratch), fan, depth, scratch)
    root = written(upper[-1].select(F.lit(0).alias("zero"), F.col("digest").alias("root")), "merkle-root")
    top = root.select(F.lit(0).alias("grp"), F.lit("").alias("siblings"), *(F.array().cast("array<int>").alias(c) for c in ("places", "sizes")))
    tops = written(_paths(upper[0], _descend(upper, top, fan, depth), fan, depth).select(F.col("group").alias("grp"), F.col("digest").alias("subroot"), *_PATH), "merkle-tops")
    headers = written(_descend(rounds, tops.drop("subroot"), fan, depth), "merkle-headers")
    for path in scratch:
        remove(spark, path)
    names = tops.select(F.col("grp").alias("grp_"), "subroot")
    root = F.broadcast(root)  # one row at most
    paths = _paths(nodes, headers, fan, depth).join(names, F.col("grp").eqNullSafe(F.col("grp_"))).join(root, F.lit(0) == F.col("zero"))
    return paths.select("grp", "id", "pos", F.col("digest").alias("leaf"), "subroot", "root", *_PATH, *(F.col(f"extra_{name}").alias(name) for name in extra))


def folded(leaf: Column, siblings: Column, places: Column, sizes: Column) -> Column:
    """The root that ``leaf`` and a path's siblings give."""
    text = siblings.cast("binary")

    def step(acc: Column, level: Column) -> Column:
        left, right = level["place"] * HEX, (level["size"] - 1 - level["place"]) * HEX
        whole = F.concat(F.substring(text, acc["used"] + 1, left), acc["node"].cast("binary"), F.substring(text, acc["used"] + left + 1, right))
        return F.struct(F.sha2(whole, 256).alias("node"), (acc["used"] + left + right).alias("used"))

    path = F.arrays_zip(places.alias("place"), sizes.alias("size"))
    return F.aggregate(path, F.struct(leaf.alias("node"), F.lit(0).alias("used")), step)["node"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: leaf, subroot, root, digest of the proof, and what a tampered leaf's proof gives."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(crc_bucket("doc_id", 5) == 0, leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns]))
    found = manifest(docs.select(*columns), columns=columns, extra={"tampered": tampered})
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("places"), F.col("sizes")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _value(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR)::VARCHAR || ':' || ({column})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, ["doc_id", "source", "lang", "n_chars", text])) + ")"


#: Level by level, runs of 16 nodes become one; ids are taken as unique and never null.
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
         xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 5 = 0 AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
lower_tree AS (
  SELECT source AS g, 0 AS lvl, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY g, lvl, pos // 16, n),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, pos, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY lvl, pos // 16, n),
nodes AS (SELECT true AS low, g, lvl, pos, n, d FROM lower_tree UNION ALL SELECT false, NULL, lvl, pos, n, d FROM upper_tree),
steps AS (
  SELECT low, g, lvl, pos,
         coalesce(string_agg(d, '') OVER (PARTITION BY low, g, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (PARTITION BY low, g, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1),
path AS (
  SELECT doc_id, lvl, l, r FROM placed p JOIN steps s ON s.low AND s.g IS NOT DISTINCT FROM p.source AND s.pos = p.pos // (16 ** s.lvl)::BIGINT
  UNION ALL
  SELECT doc_id, 100 + lvl, l, r FROM placed p JOIN subroots u ON u.g IS NOT DISTINCT FROM p.source JOIN steps s ON NOT s.low AND s.pos = u.pos // (16 ** s.lvl)::BIGINT),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k FROM path),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, CASE WHEN tampered THEN lowered ELSE leaf END AS d FROM leaves
  UNION ALL
  SELECT f.doc_id, o.k, sha256(o.l || f.d || o.r) FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
folded AS (SELECT doc_id, arg_max(d, k) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY k) AS siblings FROM ordered GROUP BY doc_id),
root AS (SELECT d AS root FROM upper_tree WHERE n = 1)
SELECT doc_id, leaf, u.d AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots u ON u.g IS NOT DISTINCT FROM p.source CROSS JOIN root JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""
