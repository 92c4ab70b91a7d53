import itertools
import json
import random

from pyspark.sql import functions as F

from symgraph.operators import timeline


def story(seed=5, n=9):
    """Events of two histories and the state (key -> value) after each commit."""
    rng, events, states = random.Random(seed), [], {}
    for repo in (1, 2):
        now = {}
        states[repo, 0] = {}
        for pos in range(1, n + 1):
            for key in rng.sample("abcdef", rng.randint(0, 4)):
                value = None if rng.random() < 0.3 else json.dumps({"v": rng.randint(0, 2)}, separators=(",", ":"))
                events.append((repo, pos, key, value))
                now.pop(key, None) if value is None else now.update({key: value})
            states[repo, pos] = dict(now)
    return events, states


SCHEMA = "repo long, pos long, key string, value string"


def test_every_way_through_the_history(spark):
    """From each commit to each other one, in both directions, by the state there and the log alone."""
    events, states = story()
    log = timeline.transition_log(spark.createDataFrame(events, SCHEMA)).persist()
    assert not log.filter("before <=> after").count()
    moves = [(r, a, b) for r in (1, 2) for a, b in itertools.permutations(range(10), 2)]
    items = [(r, p, k, v) for (r, p), state in states.items() for k, v in state.items()]
    found = timeline.replayed(spark.createDataFrame(items, "repo long, start long, key string, value string"), log, spark.createDataFrame(moves, "repo long, start long, end long"))
    got = {}
    for r in found.collect():
        assert r.key not in got.setdefault((r.repo, r.start, r.end), {})
        got[r.repo, r.start, r.end][r.key] = r.value
    assert all(got.get(m, {}) == states[m[0], m[2]] for m in moves)


def test_state_at_every_commit(spark):
    events, states = story(8)
    versions = timeline.item_versions(spark.createDataFrame(events, SCHEMA))
    asked = spark.createDataFrame([*states, (1, 9), (3, 4), (1, 1000)], "repo long, pos long")
    rows = timeline.at_commits(versions, asked).collect()
    got = {}
    for r in rows:
        assert r.key not in got.setdefault((r.repo, r.pos), {})
        got[r.repo, r.pos][r.key] = r.value
    assert all(got.get(at, {}) == state for at, state in states.items()) and got[1, 1000] == states[1, 9] and (3, 4) not in got
    plan = timeline.at_commits(versions, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_cover_an_interval_once(spark):
    pairs = [(a, b) for a in range(0, 18) for b in range(a, 20)] + [(5, 1 << 32), (0, 1 << 32), (1 << 31, (1 << 31) + 1)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", timeline.blocks_of(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        spans = sorted((b.at << b.level, b.at + 1 << b.level) for b in r.x)
        assert [s for s, _ in spans[1:]] == [e for _, e in spans[:-1]]
        assert (not spans and r.a == r.b) or (spans[0][0], spans[-1][1]) == (r.a, r.b)
        assert len(spans) <= 64


def test_snapshots_with_nulls_and_types(spark):
    schema = "id long, name string, size double, tags array<string>"
    before = spark.createDataFrame([(1, "a", 1.5, ["x"]), (2, None, None, None), (3, "c", 0.1, [])], schema)
    after = spark.createDataFrame([(1, "a", 1.5, ["x"]), (3, "c", 0.2, ["y", "z"]), (4, None, 7.0, None)], schema)
    log = timeline.log_between(before, after, ["id"])
    assert sorted(r.id for r in log.collect()) == [2, 3, 4]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(timeline.applied(before, log, ["id"]), after) and same(timeline.applied(after, log, ["id"], back=True), before)
    none = timeline.log_between(before, before, ["id"])
    assert none.isEmpty() and same(timeline.applied(before, none, ["id"]), before)


def test_payloads_stand_on_both_edges(spark):
    log = spark.createDataFrame([(1, 1, "a", None, "x"), (1, 2, "a", "x", "y"), (1, 3, "a", "y", None)], "repo long, pos long, key string, before string, after string")
    commits = spark.createDataFrame([(1, 1, "h1"), (1, 2, "h2"), (1, 3, "h3")], "repo long, pos long, hash string")
    assert {tuple(r) for r in timeline.edge_payloads(log, commits).collect()} == {("h2", "PARENT", "h1", "a", "y", "x"), ("h1", "CHILD", "h2", "a", "x", "y"), ("h3", "PARENT", "h2", "a", None, "y"), ("h2", "CHILD", "h3", "a", "y", None)}
