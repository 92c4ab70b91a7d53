"""The graph through its history: a log of what each commit changed, replayed in both directions, and the
state at any commits.

A history (``repo``) is a line of commits at positions 1, 2, ... (0: nothing yet).  Its state is a set of
items: ``key`` and ``value``, a JSON text of all properties.  Events say what a commit sets: repo, pos, key,
value, where null deletes.  Everything is keyed by (repo, key), so no history and no range of commits is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of positions where no number is given.
BITS = 32


def packed(**columns: Column) -> Column:
    """Properties as JSON; those that are null are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def unpacked(value: Column, schema: str) -> Column:
    return F.from_json(value, schema)


def transition_log(events: DataFrame) -> DataFrame:
    """events: repo, pos, key, value, one row a commit and key -> repo, pos, key, before, after of what really changes.

    Row (repo, pos) belongs to the edge between the commits at pos - 1 and pos, whichever way it is gone.
    """
    earlier = Window.partitionBy("repo", "key").orderBy("pos")
    found = events.select("repo", "pos", "key", F.lag("value").over(earlier).alias("before"), F.col("value").alias("after"))
    return found.filter(~F.col("before").eqNullSafe(F.col("after")))


def log_between(before: DataFrame, after: DataFrame, keys: list[str], pos: int = 1) -> DataFrame:
    """The log of one commit from two snapshots: keys, pos, before, after (JSON of all other columns)."""
    values = [c for c in before.columns if c not in keys]
    state = lambda df, name: df.select(*keys, packed(**{c: F.col(c) for c in values}).alias(name))
    both = state(before, "before").join(state(after, "after"), keys, "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, F.lit(pos).alias("pos"), "before", "after")


def applied(snapshot: DataFrame, log: DataFrame, keys: list[str], back: bool = False) -> DataFrame:
    """``snapshot`` with the changes of :func:`log_between` carried out (or taken back): what is needed stands in the log."""
    values = [c for c in snapshot.columns if c not in keys]
    fields = {f.name: f.dataType.simpleString() for f in snapshot.schema.fields}
    new = log.select(*keys, unpacked(F.col("before" if back else "after"), ", ".join(f"`{c}` {fields[c]}" for c in values)).alias("_new")).filter("_new is not null")
    untouched = snapshot.join(log.select(*keys), keys, "left_anti")
    return untouched.unionByName(new.select(*keys, *(F.col("_new")[c].alias(c) for c in values)))


def replayed(states: DataFrame, log: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: repo, start, end; states: repo, start, key, value, the items at ``start`` -> repo, start, end, key, value at ``end``.

    Going on, the last value that a key gets on the way counts; going back, the one it had before its first change.
    """
    way = log.join(moves, "repo").filter((F.col("pos") > F.least("start", "end")) & (F.col("pos") <= F.greatest("start", "end")))
    ahead = F.col("start") < F.col("end")
    changed = way.groupBy("repo", "start", "end", "key").agg(F.max_by("after", "pos").alias("last"), F.min_by("before", "pos").alias("first"))
    touched = changed.select("repo", "start", "end", "key", F.when(ahead, F.col("last")).otherwise(F.col("first")).alias("new"), F.lit(True).alias("hit"))
    kept = states.join(moves, ["repo", "start"]).join(touched.select("repo", "start", "end", "key"), ["repo", "start", "end", "key"], "left_anti")
    return kept.select("repo", "start", "end", "key", "value").unionByName(touched.filter("new is not null").select("repo", "start", "end", "key", F.col("new").alias("value")))


def edge_payloads(log: DataFrame, commits: DataFrame) -> DataFrame:
    """commits: repo, pos, hash -> src, rel, dst, key, before, after: each change on its PARENT edge (child to parent) and, turned round, on its CHILD edge."""
    child, parent = commits.select("repo", "pos", F.col("hash").alias("child")), commits.select("repo", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("parent"))
    both = log.join(child, ["repo", "pos"]).join(parent, ["repo", "pos"])
    back = both.select(F.col("child").alias("src"), F.lit("PARENT").alias("rel"), F.col("parent").alias("dst"), "key", F.col("after").alias("before"), F.col("before").alias("after"))
    return back.unionByName(both.select(F.col("parent").alias("src"), F.lit("CHILD").alias("rel"), F.col("child").alias("dst"), "key", "before", "after"))


def item_versions(events: DataFrame) -> DataFrame:
    """repo, key, value, valid_from, valid_to (null: still): the stretches of commits over which an item has a value."""
    w = Window.partitionBy("repo", "key").orderBy("pos")
    log = transition_log(events)
    return log.select("repo", "key", F.col("after").alias("value"), F.col("pos").alias("valid_from"), F.lead("pos").over(w).alias("valid_to")).filter("value is not null")


def blocks_of(low: Column, high: Column, bits: int | Column = BITS) -> Column:
    """The aligned blocks (level, at) that [low, high) falls into: at most two a level, a block is [at << level, at + 1 << level).  ``high`` has no more than ``bits`` + 1 bits."""

    def at_level(k: Column) -> Column:
        a, b = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", high, k)
        block = lambda place, where: F.when((a < b) & where, F.struct(k.alias("level"), place.alias("at")))
        return F.array(block(a, a % 2 == 1), block(b - 1, b % 2 == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits) if isinstance(bits, int) else bits), at_level)))


def at_commits(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: repo, pos -> repo, pos, key, value: the items at each of the commits.

    An interval join as an equi-join: an interval is cut into aligned blocks, a logarithmic number of
    them, and a position asks for the one block of each size that it lies in; exactly one of them is there.
    Intervals end at the last position that is asked, so there are only as many sizes as that has binary
    digits.  Never a broadcast: Spark's estimate of a side is that of the rows before they are multiplied.
    """
    at = asked.select("repo", F.col("pos").cast("long").alias("pos")).distinct()
    last, top = at.agg(F.max("pos")).scalar(), F.length(F.bin(F.col("last") + 1)) - 1
    low, high = F.col("valid_from").cast("long"), F.least(F.col("valid_to").cast("long"), F.col("last") + 1)  # least leaves nulls out
    cut = versions.withColumn("last", last).select("repo", "key", "value", F.explode(blocks_of(low, high, top)).alias("b")).select("repo", "key", "value", "b.level", "b.at")
    wanted = at.withColumn("last", last).select("repo", "pos", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    wanted = wanted.withColumn("at", F.call_function("shiftright", "pos", F.col("level")))
    return wanted.join(cut.hint("merge"), ["repo", "level", "at"]).select("repo", F.col("pos").cast(asked.schema["pos"].dataType).alias("pos"), "key", "value")
