import time

import pytest

from symgraph.sources import code, java
from symgraph.sources.braces import brace_file


def test_large_files_take_little_time():
    """Comments, braces and lines by the thousand: no work per pair of them."""
    java_file = brace_file("java")
    methods = "".join(f"    /** doc {i} */\n    public int get{i}(int a) {{ return other{i}(a); }}\n" for i in range(4000))
    began = time.process_time()
    rows = java_file("A.java", f"package p;\nclass A {{\n{methods}}}\n")
    assert time.process_time() - began < 5
    found = {r[2]: r for r in rows if r[1] == "method"}
    assert len(found) == 4000 and found["get7"][7] == "/** doc 7 */" and found["get7"][3:5] == ("A", "A.get7")
    assert {(r[2], r[3]) for r in rows if r[1] == "call"} == {(f"other{i}", f"A.get{i}") for i in range(4000)}
    for text in ("\n".join(["some words without any braces here"] * 4000), "\n" * 20_000, "{" * 20_000, "/* top */ class A {\n" + " void a() {}\n" * 3000 + "}"):
        began = time.process_time()
        java_file("A.java", text)
        assert time.process_time() - began < 5


def test_nearest_comment_and_innermost_braces():
    text = """
/* of A */
@Ann("x")
class A {
    // line comment
    /** of m */
    @Deprecated
    public static Map<String, int[]> m(int a) {
        Runnable r = new Runnable() { public void run() { inner(a); } };
        outer();
    }
    /** far away */
    int x;

    void n() { }
    /** above a blank line */

    void o() { }
    class B { void p() { deep(); } }
}
"""
    rows = brace_file("java")("A.java", text)
    doc = {r[2]: r[7] for r in rows if r[1] in ("class", "method")}
    assert doc["A"] == "/* of A */" and doc["m"] == "/** of m */" and doc["n"] is None and doc["o"] is None
    assert {(r[2], r[3]) for r in rows if r[1] == "call"} >= {("outer", "A.m"), ("deep", "A.B.p")}


def test_java_names_are_looked_up_in_order(spark):
    """A method name in every class: each call gets what its best rank finds, and only that."""
    files = [(f"p{i % 3}/C{i}.java", f"package p{i % 3};\nclass C{i} {{ void get() {{ }} void only{i}() {{ }} void use() {{ x.get(); y.only{(i + 1) % 6}(); }} }}\n") for i in range(6)]
    files += [("q/D.java", "package q;\nimport p1.C1;\nclass D { void a() { z.get(); } void b(C2 c) { c.get(); } void e() { get(); } }\n"), ("q/E.java", "package r;\nclass E { void f() { w.get(); } }\n")]
    rows = code.analyzed(spark.createDataFrame(files, "path string, text string"))
    got = {}
    for r in java.call_edges(rows).collect():
        got.setdefault((r.src_path, r.src), set()).add((r.dst_path, r.dst))
    for i in range(6):
        j = (i + 1) % 6
        same_package = {(f"p{i % 3}/C{k}.java", f"C{k}.get") for k in range(6) if k % 3 == i % 3}
        assert got[f"p{i % 3}/C{i}.java", f"C{i}.use"] == same_package | {(f"p{j % 3}/C{j}.java", f"C{j}.only{j}")}
    assert got["q/D.java", "D.a"] == {("p1/C1.java", "C1.get")}  # a class that is imported
    assert got["q/D.java", "D.b"] == {("p2/C2.java", "C2.get")}  # the receiver's type, found anywhere by its name
    assert len(got["q/E.java", "E.f"]) == 6  # all of that name


@pytest.mark.parametrize("text", ["x = a" + ".b" * 100_000 + "\n", "x = " + "[" * 3000 + "]" * 3000 + "\n"])
def test_deep_python_files_do_not_stop_the_others(spark, text):
    rows = code.python_rows(spark.createDataFrame([("deep.py", text), ("good.py", "def f():\n    pass\n")], "path string, text string")).collect()
    assert [r.path for r in rows if r.kind == "function"] == ["good.py"]
