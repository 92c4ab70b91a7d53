import textwrap

from symgraph.operators import security
from symgraph.sources import code, securitypass
from symgraph.sources.flow import python_flow

VIEW = textwrap.dedent("""
    from flask import render_template as rt
    import shop.tools

    @app.post("/buy")
    @login_required
    def buy(request):
        raw = request.args["q"]
        for part in raw.split(","):
            total = total_of(part)
        with opened(total) as handle:
            safe: str = sanitize_q(handle)
        again = safe
        again.note = raw
        return render_template("t.html", q=again, bad=raw, both=(safe, raw), direct=html_escape(raw), const=1)

    class Shop:
        def show(self):
            x = y
            x, (y, *z) = y, x
            return TemplateResponse("t.html", x=x)
    """)


def test_flow_rows_of_a_file():
    rows = {r[1:5] for r in python_flow("a.py", VIEW)}
    assert {("buy", "route", "/buy", "POST"), ("buy", "assign", "raw", "request"), ("buy", "assign", "part", "raw"), ("buy", "assign_call", "total", "total_of"), ("buy", "assign", "handle", "total"), ("buy", "assign_call", "safe", "sanitize_q"), ("buy", "assign", "again", "safe"), ("buy", "assign", "again", "raw")} <= rows
    assert {("buy", "render", "q", "again"), ("buy", "render", "both", "safe"), ("buy", "render", "both", "raw"), ("buy", "render_call", "direct", "html_escape"), ("buy", "render", "direct", "raw")} <= rows
    assert {("Shop.show", "assign", "x", "y"), ("Shop.show", "assign", "y", "x"), ("Shop.show", "assign", "z", "x"), ("Shop.show", "render", "x", "x")} <= rows
    assert not [r for r in rows if r[2] == "const"] and python_flow("a.py", "def f(:") == []


def test_texts_too_deep_for_the_parser_have_no_rows():
    for deep in ("x = a" + ".b" * 100_000, "x = " + "-" * 100_000 + "1", "x = " + "+".join(["1"] * 100_000), "x = " + "(" * 5000 + ")" * 5000):
        assert code.python_file("a.py", deep + "\n") == [] or deep.count("+") or "(" in deep
        assert isinstance(python_flow("a.py", f"def f():\n    {deep}\n"), list)


def test_processed_follows_chains_and_cycles(spark):
    flow = spark.createDataFrame(python_flow("a.py", VIEW), "path string, owner string, kind string, name string, target string, line int")
    assert {tuple(r) for r in securitypass.processed(flow).collect()} == {("a.py", "buy", "q", "sanitize_q"), ("a.py", "buy", "both", "sanitize_q"), ("a.py", "buy", "direct", "html_escape")}


def test_graph_of_a_small_project(spark):
    files = [
        ("web/view.py", VIEW), ("web/clean.py", "def sanitize_q(x):\n    return x\n"), ("venv/lib.py", "@x\ndef f():\n    open('a')\n"), ("broken.py", "def ("),
        ("t.html", "<p>{{ q }} {{bad}}</p>\n<form>\n{{ both }}\n</form>"), ("api.md", "- before\n## POST /buy\n* one\n+ two\n### Other\n"), ("openspec/specs/x.md", "## GET /hidden\n"), ("empty.md", ""),
    ]
    nodes, edges = securitypass.secured(spark.createDataFrame(files, "path string, text string"))
    found = {(r.label, r.name, r.path) for r in nodes.collect()}
    assert {("Variable", "q", "web/view.py"), ("Route", "POST", "/buy"), ("MarkdownSection", "Other", "api.md"), ("Requirement", "one", "api.md"), ("Requirement", "two", "api.md"), ("HtmlForm", "form", "t.html"), ("Function", "sanitize_q", "web/clean.py"), ("Function", "html_escape", None)} <= found
    assert {x[:2] for x in found if x[2] and ("venv" in x[2] or "openspec" in x[2])} == {("Function", "f")} and ("Requirement", "before", "api.md") not in found
    assert nodes.count() == nodes.select("id").distinct().count()
    ids = {r.id: (r.label, r.name) for r in nodes.collect()}
    linked = {(ids.get(r.src), r.rel, ids.get(r.dst)) for r in edges.collect()}
    assert (("Variable", "q"), "PROCESSED_BY", ("Function", "sanitize_q")) in linked and (("Variable", "both"), "INJECTED_INTO", ("HtmlForm", "form")) in linked
    assert (("MarkdownSection", "POST /buy"), "DEFINES_ROUTE", ("Route", "POST")) in linked and (("MarkdownSection", "POST /buy"), "DEFINES_REQUIREMENT", ("Requirement", "two")) in linked
    assert {(r.UnsafeVariable, r.TargetElement) for r in security.xss(nodes, edges).collect()} == {("bad", "p")}
    assert [(r.UnsecuredRoute, r.HandlerFunction) for r in security.auth_drift(nodes, edges).collect()] == [("/buy", "no handler found")]
    again = securitypass.secured(spark.createDataFrame(files[::-1], "path string, text string").repartition(5))
    assert [sorted(map(str, df.collect())) for df in again] == [sorted(map(str, df.collect())) for df in (nodes, edges)]


def test_no_files(spark):
    nodes, edges = securitypass.secured(spark.createDataFrame([], "path string, text string"))
    assert nodes.isEmpty() and edges.isEmpty()
