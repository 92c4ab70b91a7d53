import random

from symgraph.operators.intervals import enclosing


def nested(rng, low, high, next_id, out, depth=0):
    at = low
    while at < high and depth < 5:
        a = at + rng.randint(0, 3)
        b = min(a + rng.randint(0, 12), high)
        if a > high:
            break
        out.append((next_id[0], a, b))
        next_id[0] += 1
        if b - a > 1:
            nested(rng, a + 1, b - 1, next_id, out, depth + 1)
        at = b + 1


def test_same_as_looking_at_every_definition(spark):
    rng, defs, next_id = random.Random(2), [], [1]
    for path in "abc":
        own = []
        nested(rng, 1, 60, next_id, own)
        defs += [(path, *d) for d in own]
    defs.append(("d", 900, 5, 5))
    places = [(p, at, f"{p}{at}") for p in "abcde" for at in range(0, 64)]
    got = {r.name: r.id for r in enclosing(spark.createDataFrame(defs, "path string, id long, start int, end int"), spark.createDataFrame(places, "path string, at int, name string")).collect()}
    assert len(got) == len(places)
    for path, at, name in places:
        around = [(s - e, i) for p, i, s, e in defs if p == path and s <= at <= e]
        assert got[name] == (max(around)[1] if around else None)


def test_without_definitions_or_places(spark):
    defs, places = spark.createDataFrame([], "path string, id long, start int, end int"), spark.createDataFrame([("a", 1)], "path string, at int")
    assert [tuple(r) for r in enclosing(defs, places).collect()] == [("a", 1, None)] and enclosing(defs, places.limit(0)).isEmpty()
