"""Source code, search and state on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import context, pattern, search, store, traverse
from symgraph.plans import fixtures
from symgraph.shared import new_folder
from symgraph.sources import code, java
from symgraph.sources.braces import brace_file

JAVA = """package com.a.b;
import com.x.User;
/** The service. */
@Service("x")
public class Svc<T> extends Base implements Runner, Other<T> {
    private final User user = new User("a{b");
    // not a doc
    public Svc(User u) { this.user = u; init(); }
    /* runs */
    @Override
    public List<User> run(int n, User u) throws IOException {
        if (n > 0) { u.save(x); this.user.load(); super.go(); }
        return Helper.make(x).done();
    }
    abstract void todo();
    static class Inner { void m() { help(); } }
}
interface Runner extends A, B { void go(String s); }
record P(int a) implements Runner { }
"""
KOTLIN = """/** Doc */
class A(val x: Int) : B(x), C {
    fun m(u: User): String { helper(n); return u.name() }
}
interface I { fun z() }
/* no KDoc */
object O : C { fun q() {} }
fun top(a: A) { a.m() }
"""
CSHARP = """/// one
/// two
public class A : B, IC {
  public A(D d) { Go(); }
  public string Run(User u) { u.Save(); return Make<int>(1); }
}
struct S : I { }
interface I : J { void Z(); }
"""
SCRIPT = """// hi
function top(a) { other(a); }
class A extends B {
  /* m */
  m(x) { top(x); this.n(); if (x) { y.z(); } }
  static n() { return new C(); }
}
"""


def facts(language, source):
    rows = brace_file(language)("f", source)
    defined = {r[4]: (r[1], r[7]) for r in rows if r[1] in ("class", "interface", "enum", "struct", "object", "method", "constructor", "function")}
    uses = {(r[1], r[3], r[2]) for r in rows if r[1] in ("base", "implements", "call", "parameters", "return_type")}
    return defined, uses


def test_java_file():
    defined, uses = facts("java", JAVA)
    assert defined == {
        "Svc": ("class", "/** The service. */"), "Svc.Svc": ("constructor", None), "Svc.run": ("method", "/* runs */"), "Svc.todo": ("method", None), "Svc.Inner": ("class", None), "Svc.Inner.m": ("method", None),
        "Runner": ("interface", None), "Runner.go": ("method", None), "P": ("class", None),
    }
    assert {u for u in uses if u[0] in ("base", "implements")} == {("base", "Svc", "Base"), ("implements", "Svc", "Runner"), ("implements", "Svc", "Other"), ("base", "Runner", "A"), ("base", "Runner", "B"), ("implements", "P", "Runner")}
    assert {u[1:] for u in uses if u[0] == "call"} == {("Svc.Svc", "init"), ("Svc.run", "save"), ("Svc.run", "load"), ("Svc.run", "go"), ("Svc.run", "make"), ("Svc.run", "done"), ("Svc.Inner.m", "help")}
    assert ("return_type", "Svc.run", "List") in uses and ("parameters", "Svc.run", "User") in uses


def test_kotlin_csharp_and_javascript_files():
    defined, uses = facts("kt", KOTLIN)
    assert defined == {"A": ("class", "/** Doc */"), "A.m": ("method", None), "I": ("interface", None), "I.z": ("method", None), "O": ("object", None), "O.q": ("method", None), "top": ("function", None)}
    assert uses == {("base", "A", "B"), ("implements", "A", "C"), ("implements", "O", "C"), ("parameters", "A.m", "User"), ("return_type", "A.m", "String"), ("call", "A.m", "helper"), ("call", "A.m", "name"), ("parameters", "top", "A"), ("call", "top", "m")}
    defined, uses = facts("cs", CSHARP)
    assert defined["A"] == ("class", "/// one\n/// two") and {k: v[0] for k, v in defined.items()} == {"A": "class", "A.A": "constructor", "A.Run": "method", "S": "struct", "I": "interface", "I.Z": "method"}
    assert {u for u in uses if u[0] in ("base", "implements")} == {("base", "A", "B"), ("implements", "A", "IC"), ("implements", "S", "I"), ("base", "I", "J")}
    assert {u[2] for u in uses if u[0] == "call"} == {"Go", "Save", "Make"}
    defined, uses = facts("js", SCRIPT)
    assert defined == {"top": ("function", "// hi"), "A": ("class", None), "A.m": ("method", "/* m */"), "A.n": ("method", None)}
    assert uses == {("base", "A", "B"), ("call", "top", "other"), ("call", "A.m", "top"), ("call", "A.m", "n"), ("call", "A.m", "z")}


def test_java_lookup_order(spark):
    files = [
        ("a/A.java", "package a; import b.Only; class A { void x() { m(); Only.s(); far(); two(); } } class Two { void two() { } }"),
        ("b/Only.java", "package b; public class Only extends Up implements Side { } class Up { } interface Side { default void s() { } }"),
        ("c/C.java", "package c; class C { void far() { } void two() { } void two(int n) { } } class Side { void s() { } }"),
        ("lib.jar/D.java", "package d; class D { void y() { far(); } }"),
    ]
    rows = code.analyzed(spark.createDataFrame(files, "path string, text string"))
    calls = {(r.src, r.dst_path, r.dst) for r in java.call_edges(rows).collect()}
    assert calls == {("A.x", "b/Only.java", "Side.s"), ("A.x", "c/C.java", "C.far"), ("A.x", "a/A.java", "Two.two")}
    types = {(r.rel, r.src, r.dst_path) for r in java.type_edges(rows).collect()}
    assert types == {("EXTENDS", "Only", "b/Only.java"), ("IMPLEMENTS", "Only", "b/Only.java")}


PYTHON = [
    ("a/__init__.py", "from .util import f\nfrom . import util\n"),
    ("a/util.py", "def f():\n    return 1\n"),
    ("b/__init__.py", ""),
    ("b/util.py", "class K:\n    def go(self): pass\n\ndef f():\n    return 2\n"),
    ("b/x.py", "from .util import f\nfrom . import util as u\nimport a.util\nfrom .... import zzz\nf2 = 3\n\ndef own():\n    f()\n    lonely()\n    f2()\n\nclass M(u.K.go):\n    pass\n\nclass N(u.K): pass\n"),
    ("c.py", "def lonely():\n    'doc ' + 'x'\n    return 1\n\ndef twice(): pass\n"),
    ("d.py", "def twice(): pass\n\ndef z():\n    twice()\n"),
    ("e.py", "def use():\n    twice()\n"),
    ("venv/q.py", "import c\n\ndef r():\n    lonely()\n"),
]


def test_python_names_are_resolved_in_order(spark):
    files = spark.createDataFrame(PYTHON, "path string, text string")
    rows = code.python_rows(files)
    assert {(r.src, r.dst) for r in code.resolve_imports(rows, files).collect()} == {("a/__init__.py", "a/util.py"), ("b/x.py", "b/util.py"), ("b/x.py", "b/__init__.py"), ("b/x.py", "a/util.py"), ("venv/q.py", "c.py")}
    found = {(r.rel, r.src_path, r.src, r.dst_path, r.dst) for r in code.resolve_uses(rows).collect()}
    assert found == {
        ("CALLS", "b/x.py", "own", "b/util.py", "f"), ("CALLS", "b/x.py", "own", "c.py", "lonely"), ("CALLS", "b/x.py", "own", "b/x.py", "f2"), ("EXTENDS", "b/x.py", "M", "b/util.py", "K.go"), ("EXTENDS", "b/x.py", "N", "b/util.py", "K"),
        ("CALLS", "d.py", "z", "d.py", "twice"),
    }
    docs = {r.name: r.doc for r in rows.filter("kind = 'function'").collect()}
    assert docs["lonely"] == "'doc ' + 'x'" and docs["own"] == "f()"


def test_own_analyzers_and_dependencies(spark, monkeypatch):
    monkeypatch.setitem(code.ANALYZERS, "toy", lambda path, t: [(path, "function", t, None, t, 1, 1, None)])
    files = spark.createDataFrame([("a.toy", "x"), ("b.txt", "y"), ("c.py", "def (")], "path string, text string")
    assert [(r.path, r.name) for r in code.analyzed(files).collect()] == [("a.toy", "x")]
    paths = spark.createDataFrame([(p,) for p in ("venv/a.py", "a.py", "x.jar/A.java", "node_modules/a.js", "my_node_modules/a.js", "build/a.kt", "a.html", "temp_deps_cs/a.cs")], "path string")
    assert [r[0] for r in paths.filter(code.is_dependency(F.col("path"))).collect()] == ["venv/a.py", "x.jar/A.java", "node_modules/a.js", "build/a.kt", "temp_deps_cs/a.cs"]
    kept = paths.filter(~code.ignored(F.col("path"), ["node_"], ["venv"], ["**/build/**"]))
    assert [r[0] for r in kept.collect()] == ["a.py", "x.jar/A.java", "a.html", "temp_deps_cs/a.cs"]
    parts = paths.limit(1).select(code.module_parts(F.lit("/r/p/a/__init__.py"), "/r/p").alias("a"), code.module_parts(F.lit("/r/q/a.py"), "/r/p").alias("b")).first()
    assert parts.a == ["p", "a"][1:] and parts.b is None


def test_html_elements_and_references(spark):
    page = '<html>\n<body id="top"><!-- {{ no }} -->\n<form action="/{{ act }}"><input value="{{v}}"><br/>\n</form>\n<p>{{ v }} {{ a.b }} {{ w }}\n</body></html>'
    rows = {r.name: r for r in code.html_rows(spark.createDataFrame([("p.html", page), ("q.html", None)], "path string, text string")).collect()}
    assert {n: (r.label, r.start, r.end, r.refs) for n, r in rows.items()} == {
        "html": ("HtmlElement", 1, 6, ["act", "v", "w"]), "body#top": ("HtmlElement", 2, 6, ["act", "v", "w"]), "form": ("HtmlForm", 3, 4, ["act", "v"]), "input": ("HtmlElement", 3, 3, ["v"]),
        "br": ("HtmlElement", 3, 3, []), "p": ("HtmlElement", 5, 6, ["v", "w"]),
    }


def test_snippets(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x", "", " @deco", "def f():", "y" * 300, "z", "w", "v"], 1)], "path string, line int, text string")
    symbols = spark.createDataFrame([(1, "a", 2, 8), (2, "a", 0, 5), (3, "b", 1, 2), (4, "a", 3, None), (5, "a", 6, 6)], "id int, path string, start int, end int")
    got = {r.id: r.snippet for r in search.snippets(symbols, lines, 3).collect()}
    assert got == {1: "def f():\n" + "y" * 200 + "\nz", 5: "z"}


def test_arguments_are_checked():
    assert search.valid_relation("HAS_X1") == "HAS_X1" and search.whole_number("-12") == -12 and search.clamped("900", 200) == 200 and search.clamped(-3, 10) == 1
    for bad in (lambda: search.valid_relation("A]->()"), lambda: search.valid_relation(None), lambda: search.whole_number(True), lambda: search.whole_number("x"), lambda: search.whole_number(1.5), lambda: pattern.find_symbol(None, " . ")):
        with pytest.raises(ValueError):
            bad()


def test_documents_of_a_file_are_capped(spark):
    rows = [(1, "f", "one two", 1), (2, "f", "three four", 2), (3, "f", "five", None), (4, "g", None, 1)]
    out = search.capped_docs(spark.createDataFrame(rows, "id int, file string, doc string, start int"), 6).collect()
    assert {r.id: len(r.body) for r in out} == {1: 4, 2: 2, 3: 0, 4: 0}


def test_graphs_are_saved_cloned_renamed_and_deleted(spark):
    root = new_folder(spark, "graphs")
    nodes, edges = fixtures.web(spark)
    store.save_graph(nodes, edges, root, "a")
    store.clone_graph(spark, root, "a", "b")
    with pytest.raises(ValueError):
        store.clone_graph(spark, root, "a", "b")
    store.rename_graph(spark, root, "b", "c")
    assert not store.graph_exists(spark, root, "b") and store.load_graph(spark, root, "c")[0].count() == nodes.count()
    assert store.delete_graph(spark, root, "c") and not store.graph_exists(spark, root, "c")
    assert store.load_graph(spark, root, "a")[1].count() == edges.count()


def test_context_text(spark):
    nodes, edges = fixtures.web(spark)
    nodes = nodes.select("id", "label", "name", "path", F.lit("A doc").alias("doc")).unionByName(spark.createDataFrame([(30, "Class", "Big", "web.py", "x" * 4000), (31, "Requirement", "must show", "api.md", None)], "id long, label string, name string, path string, doc string"))
    edges = edges.unionByName(spark.createDataFrame([(30, 1, "DEFINES"), (30, 2, "DEFINES"), (11, 31, "DEFINES_REQUIREMENT")], "src long, dst long, rel string"))
    wanted = context.resolve(nodes, spark.createDataFrame([("Big",), ("adm",), ("Show",), ("nothing",), ("web.p",)], "capability string"))
    entities = wanted.filter("capability <> 'nothing'")
    assert {r.capability: (r.rank, r.id) for r in entities.collect()} == {"Big": (1, 30), "adm": (5, 15), "Show": (7, 11)}
    found = context.items(nodes, edges, entities)
    got = {(r.id, r.section): r.item for r in found.orderBy("n").collect() if r.n == 1}
    assert got == {(30, "methods"): "admin", (30, "calls"): "dump", (30, "auth"): "login_required", (30, "fs_ops"): "open", (11, "requirements"): "must show"}
    texts = {r.id: r.context for r in context.texts(entities, found).collect()}
    assert len(texts[30]) == 2998 and texts[30].endswith("…") and texts[30].startswith("[CAPABILITY]\nName: Big\nFile: web.py\nType: Class\n\n[DOCSTRING]\nxxx")
    assert texts[11].endswith("[CALLS]\n  (none)\n\n[AUTH]\n  (none)\n\n[FS_OPS]\n  (none)\n\n[EXISTING REQUIREMENTS]\n  - must show")


def test_paths_without_a_length_and_multi_source_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (9, 9)], "src long, dst long")
    paths = {(r.dst, tuple(r.nodes)) for r in traverse.call_paths(edges, 1, 5).collect()}
    assert paths == {(5, (1, 2, 4, 5))}
    assert {r.dst for r in traverse.call_paths(edges, 9).collect()} == {9}
    assert {r.id for r in traverse.reached(edges, spark.createDataFrame([(4,), (9,)], "id long")).collect()} == {4, 5, 9}
    shortest = {(r.src, r.dst): (r.hops, r.nodes) for r in traverse.shortest_paths(edges, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(5,), (1,)], "id long")).collect()}
    assert shortest == {(1, 5): (3, [1, 2, 4, 5])}


def test_names_and_penalties(spark):
    row = lambda *columns: spark.range(1).select(*columns).first()
    paths = ["src/tests/a.py", "a/conftest/x", "b_test.py", "x/test_a.py", "migrations/1.py", "node_modules/a.js", "src/main.py", "Docs/x.md", "__pycache__/x"]
    hit = spark.createDataFrame([(p,) for p in paths], "p string").filter(F.col("p").rlike(text.PENALISED)).collect()
    assert [r.p for r in hit] == [p for p in paths if p not in ("node_modules/a.js", "src/main.py")]
    assert row(text.helper_key(F.lit("p"), F.lit("")), text.info_key(F.lit("p")), text.slug(F.lit("A_b")), text.graph_name(F.lit("p"), F.lit("x/y"))) == ("{p}:_default_info", "{p}_info", "a-b", "code:p:x/y")
