import hashlib
import zlib

import pytest

from symgraph.llm.merkle import block_digest, levels, manifest, op13_merkle_manifest, traverse


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan):
    """All levels, the given nodes first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][a : a + fan])) for a in range(0, len(out[-1]), fan)])
    return out


def path(tiers, i, fan):
    found = []
    for nodes in tiers[:-1]:
        first = i - i % fan
        run = nodes[first : first + fan]
        found.append((i % fan, [x for j, x in enumerate(run) if j != i % fan]))
        i //= fan
    return found


def fold(leaf, steps):
    for at, others in steps:
        leaf = sha("".join([*others[:at], leaf, *others[at:]]))
    return leaf


def brute(docs, fan=16):
    """doc (id, source, ...) -> leaf, subroot, root, steps; docs are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, plain(d)))
    tiers = {g: tree([plain(d) for d in groups[g]], fan) for g in order}
    top = tree([tiers[g][-1][0] for g in order], fan)
    out = []
    for at, g in enumerate(order):
        for i, d in enumerate(groups[g]):
            out.append((d, tiers[g][0][i], tiers[g][-1][0], top[-1][0], path(tiers[g], i, fan) + path(top, at, fan)))
    return out


@pytest.mark.parametrize("fan", [2, 3, 16])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 15, 16, 17, 31, 255, 256, 257, 300, 4096])
def test_traversal_gives_the_paths_of_the_whole_tree(n, fan):
    if fan != 16 and n > 300:
        return
    leaves = [sha(str(i)) for i in range(n)]
    tiers = tree(leaves, fan)
    depth = levels(n, fan)
    assert depth == len(tiers) - 1 and block_digest(leaves, depth, fan) == tiers[-1][0]
    for i, (siblings, at, size) in enumerate(traverse(leaves, depth, fan, "above")):
        expected = path(tiers, i, fan)
        assert siblings == "".join("".join(o) for _, o in expected) + "above"
        assert at == [a for a, _ in expected] and size == [len(o) + 1 for _, o in expected]


def test_a_block_that_ends_early_still_has_all_its_levels():
    leaves = ["a", "b"]
    assert block_digest(leaves, 3) == sha(sha(sha("ab")))
    assert list(traverse(leaves, 3)) == [("b", [0, 0, 0], [2, 1, 1]), ("a", [1, 0, 0], [2, 1, 1])]


DOCS = (
    [(i, "hot", "en", i % 7, f"Text {i}") for i in range(150)]
    + [(i, f"s{i % 5}", None, None, "x" * i) for i in range(200, 240)]
    + [(1, None, "de", 3, None), (None, None, None, None, None), (None, "hot", "en", 1, "no id"), (7, "lone", "fr", 0, ""), (3, "hot", "en", 3, "Text 3"), (3, "hot", "en", 3, "another"), (900, "long", "en", 1, "Wört " * 100_000), (2**62 + 1, "hot", "en", 1, "large id")]
)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fan", "depth"), [(16, 3), (2, 2), (3, 1)])
def test_same_as_brute_force(spark, fan, depth):
    """Also with blocks so small that several rounds are needed, nulls, ties, repeated rows and other columns."""
    df = spark.createDataFrame([(*d, "g", 5) for d in DOCS], f"{SCHEMA}, grp string, pos int")
    rows = manifest(df, columns=["doc_id", "source", "lang", "n_chars", "text"], fan=fan, depth=depth).collect()
    expected = brute(DOCS, fan)
    found = sorted((str(r.id), str(r.grp), r.leaf, r.subroot, r.root, r.siblings, tuple(r.places), tuple(r.sizes)) for r in rows)
    assert found == sorted((str(d[0]), str(d[1]), leaf, sub, root, "".join("".join(o) for _, o in steps), tuple(a for a, _ in steps), tuple(len(o) + 1 for _, o in steps)) for d, leaf, sub, root, steps in expected)


def test_empty_table_and_other_types(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = manifest(spark.createDataFrame([(1, 2, "a")], "`a.b` int, id int, t string"), group_col="a.b", id_col="id").collect()
    assert [(r.leaf, r.subroot, r.root, r.siblings) for r in one] == [(plain([1, 2, "a"]),) * 3 + ("",)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = {r.doc_id: r for r in op13_merkle_manifest(spark, f"/root/testdata/sf{sf}").collect()}
    assert len(got) == len(docs)
    for d, leaf, sub, root, steps in brute(docs):
        r = got[d[0]]
        changed = leaf
        if zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
            changed = plain([*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])])
        back = fold(changed, steps)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, sub, root, sha("".join("".join(o) for _, o in steps)))
        assert (r.folded_root, r.verified) == (back, back == root)
