from symgraph.sources import spectree

SPEC = """# Login
## Purpose
Users log in.
### Requirement: not one
Safely.

## Requirements
### Requirement: Session
The system SHALL keep a session.
- **GIVEN** part of the prose
#### Scenario: Good password
- **GIVEN** a user
- **AND** a password
- **WHEN** they log in
- **AND** wait
- **then** they are in
- **AND** see a page
#### Scenario: Empty
### Requirement: Bare
## Notes
text
"""
DELTA = """## ADDED Requirements
### Requirement: New
Must be new.
#### Scenario: x
## RENAMED Requirements
- TO: `### Requirement: Lost`
- FROM: `### Requirement: Old`
- TO: `### Requirement: Newer`
- TO: `### Requirement: Again`
## REMOVED Requirements
### Requirement: Gone
"""
TASKS = "- [ ] loose\n## 1. Build\n- [x] 1.1 Write it\r\n  - [X] 1.2.3  Test it\n- [] no box\n* [ ] no dash\n## Ship\n- [ ] 2 \n"


def files(spark):
    rows = [("r/openspec/specs/login/spec.md", SPEC), ("r/openspec/changes/c1/tasks.md", TASKS), ("r/openspec/changes/c1/specs/login/spec.md", DELTA), ("r/openspec/changes/archive/tasks.md", TASKS), ("r/openspec/specs/none/spec.md", None), ("r/other/spec.md", SPEC)]
    return spark.createDataFrame(rows, "path string, text string")


def test_spec(spark):
    specs = spectree.specs(files(spark))
    assert sorted(r["name"] for r in specs.collect()) == ["login", "none"]
    assert {r.path.split("/")[3]: r.purpose for r in spectree.capabilities(specs).collect()} == {"login": "Users log in. Safely.", "none": ""}
    assert sorted((r.line, r["name"], r.text) for r in spectree.requirements(specs).collect()) == [(8, "Session", "The system SHALL keep a session. - **GIVEN** part of the prose"), (19, "Bare", "")]
    got = sorted(tuple(r)[1:] for r in spectree.scenarios(specs).collect())
    assert got == [(8, 11, "Good password", "a user | a password", "they log in | wait", "they are in | see a page"), (8, 18, "Empty", "", "", "")]


def test_tasks(spark):
    got = sorted(tuple(r)[1:] for r in spectree.tasks(spectree.change_tasks(files(spark))).collect())
    assert got == [(1, "", "", "loose", False), (3, "1. Build", "1.1", "Write it", True), (4, "1. Build", "1.2.3", "Test it", True), (8, "Ship", "", "2", False)]


def test_deltas(spark):
    changes = spectree.change_specs(files(spark))
    assert [(r["name"], r.capability) for r in changes.collect()] == [("c1", "login")]
    got = sorted(tuple(r)[1:] for r in spectree.deltas(changes).collect())
    assert got == [
        (2, "ADDED", "CHANGE_ADDS_REQUIREMENT", "New", "Must be new."),
        (8, "RENAMED", "CHANGE_MODIFIES_REQUIREMENT", "Newer", "(renamed from: Old)"),
        (11, "REMOVED", "CHANGE_REMOVES_REQUIREMENT", "Gone", ""),
    ]


def test_spec_graph_drops_what_a_file_no_longer_says(spark):
    from symgraph.plans import fixtures
    from symgraph.sources import specgraph

    files = fixtures.spec_tree(spark).unionByName(spark.createDataFrame([("p/openspec/changes/c1/.openspec.yaml", "created: 2024-01-01\nschema: v1\n")], "path string, text string"))
    nodes, edges = specgraph.spec_graph(files)
    names = {r.id: (r.label, r.props.get("name") or r.props.get("text") or r.props.get("capability")) for r in nodes.collect()}
    linked = {(names[r.src][1], r.rel, names[r.dst][1]) for r in edges.collect()}
    assert linked == {
        ("login", "DEFINES_REQUIREMENT", "Session"), ("login", "DEFINES_REQUIREMENT", "Bare"), ("Session", "HAS_SCENARIO", "Known"), ("c1", "CHANGE_HAS_TASK", "loose"), ("c1", "CHANGE_HAS_TASK", "Write it"), ("c1", "CHANGE_HAS_TASK", "test it"),
        ("c1", "CHANGE_TARGETS_CAPABILITY", "login"), ("c1", "CHANGE_ADDS_REQUIREMENT", "New"), ("c1", "CHANGE_MODIFIES_REQUIREMENT", "Newer"),
    }
    change = next(r for r in nodes.collect() if r.label == "OpenSpecChange")
    assert change.props["created"] == "2024-01-01" and change.props["path"] == "p/openspec/changes/c1"
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    again = specgraph.reindexed_specs(nodes, edges, files)
    assert same(again[0].select("id", "label"), nodes.select("id", "label")) and same(again[1].select("src", "rel", "dst"), edges.select("src", "rel", "dst"))
    shorter = spark.createDataFrame([("p/openspec/specs/login/spec.md", "## Requirements\n### Requirement: Bare\n")], "path string, text string")
    gone = spark.createDataFrame([("p/openspec/changes/c1/tasks.md",)], "path string")
    less = specgraph.reindexed_specs(nodes, edges, shorter, gone)
    assert {(names[r.src][1], r.rel, names[r.dst][1]) for r in less[1].collect()} == {t for t in linked if "Session" not in t and t[1] != "CHANGE_HAS_TASK"}
    assert not {names[r.id][1] for r in less[0].collect()} & {"Session", "Known", "loose", "Write it"}
    none = specgraph.reindexed_specs(*less, files.limit(0), files.select("path"))
    assert none[0].isEmpty() and none[1].isEmpty()
