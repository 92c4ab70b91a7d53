"""Queries over histories: every customer is a repository, its orders are the commits, line items what they change."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import timeline
from .registry import query
from .shared import written
from .sources import testgraph as g


def _commits(spark, d):
    """repo, pos, hash: the orders of each customer by date."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return g.table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.row_number().over(order).alias("pos"), F.col("o_orderkey").alias("hash"))


def _events(spark, d):
    """An order sets twenty items at most, each by its last line; a line that came back deletes."""
    lines = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag").alias("line"))
    last = lines.groupBy("hash", "key").agg(F.max("line").alias("line"))
    value = F.when(F.col("line.l_returnflag") != "A", timeline.packed(part=F.col("line.l_partkey"), q=F.col("line.q")))
    return _commits(spark, d).join(last, "hash").select("repo", "pos", "key", value.alias("value"))


_EVENTS = """c AS (SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey AS hash FROM orders),
ev AS (SELECT repo, pos, 'p' || l_partkey % 20 AS key, CASE WHEN l_returnflag <> 'A' THEN '{"part":' || l_partkey || ',"q":' || l_quantity::INT || '}' END AS value FROM c JOIN lineitem ON l_orderkey = hash
  QUALIFY row_number() OVER (PARTITION BY hash, l_partkey % 20 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity::INT DESC, l_returnflag DESC) = 1),
st AS (SELECT *, lead(pos) OVER (PARTITION BY repo, key ORDER BY pos) AS until FROM ev),
ends AS (SELECT repo, max(pos) AS n FROM c GROUP BY repo)"""


@query(f"WITH {_EVENTS}, l AS (SELECT repo, pos, key, lag(value) OVER (PARTITION BY repo, key ORDER BY pos) AS before, value AS after FROM ev) SELECT * FROM l WHERE before IS DISTINCT FROM after")
def transition_log(spark, d):
    return timeline.transition_log(_events(spark, d))


@query(f"""WITH {_EVENTS}, ways AS (SELECT repo, unnest([0, n]) AS start, (n + 1) // 2 AS "end" FROM ends)
SELECT w.repo, start::BIGINT AS start, "end"::BIGINT AS "end", key, value FROM ways w JOIN st ON st.repo = w.repo AND pos <= "end" AND (until IS NULL OR until > "end") WHERE value IS NOT NULL AND (start <> "end")""")
def transition_replay(spark, d):
    """The middle of every history, gone to from nothing and back from the end, by the first and last states and the log alone."""
    events = written(_events(spark, d), "events")
    log = written(timeline.transition_log(events), "log")
    ends = _commits(spark, d).groupBy("repo").agg(F.max("pos").cast("long").alias("n"))
    middle = F.expr("(n + 1) div 2").cast("long")
    moves = ends.select("repo", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("start"), middle.alias("end")).filter("start <> end")
    last = events.groupBy("repo", "key").agg(F.max_by("value", "pos").alias("value")).filter("value is not null").join(ends, "repo").select("repo", F.col("n").alias("start"), "key", "value")
    return timeline.replayed(last, log, moves)


@query(f"""WITH {_EVENTS}, e AS (SELECT a.hash AS child, b.hash AS parent, a.repo, a.pos FROM c a JOIN c b ON a.repo = b.repo AND a.pos = b.pos + 1),
l AS (SELECT repo, pos, key, lag(value) OVER (PARTITION BY repo, key ORDER BY pos) AS before, value AS after FROM ev)
SELECT unnest([child, parent]) AS src, unnest(['PARENT', 'CHILD']) AS rel, unnest([parent, child]) AS dst, key, unnest([after, before]) AS before, unnest([before, after]) AS after FROM l JOIN e USING (repo, pos) WHERE before IS DISTINCT FROM after""")
def transition_edges(spark, d):
    return timeline.edge_payloads(timeline.transition_log(_events(spark, d)), _commits(spark, d))


@query(f"""WITH {_EVENTS}, a AS (SELECT repo, pos FROM c) SELECT a.repo, a.pos, key, value FROM a JOIN st ON st.repo = a.repo AND st.pos <= a.pos AND (until IS NULL OR until > a.pos) WHERE value IS NOT NULL""")
def state_at_commits(spark, d):
    """The items at every commit of all histories at once."""
    versions = timeline.item_versions(_events(spark, d))
    return timeline.at_commits(versions, _commits(spark, d))


@query("""WITH p AS (SELECT p_partkey AS key, p_name, p_size FROM part) SELECT 'on' AS way, key, CASE WHEN key % 11 = 0 THEN 'new' ELSE p_name END AS p_name, p_size FROM p WHERE key % 5 <> 0
UNION ALL SELECT 'back', key, p_name, p_size FROM p WHERE key % 7 <> 0""")
def snapshot_replay(spark, d):
    """One log between two snapshots turns each into the other."""
    part = g.table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_size")
    before = part.filter("key % 7 <> 0")
    after = part.filter("key % 5 <> 0").withColumn("p_name", F.when(F.col("key") % 11 == 0, "new").otherwise(F.col("p_name")))
    log = written(timeline.log_between(before, after, ["key"]), "log")
    on, back = timeline.applied(before, log, ["key"]), timeline.applied(after, log, ["key"], back=True)
    return on.withColumn("way", F.lit("on")).unionByName(back.withColumn("way", F.lit("back")))
