"""Source trees as tables: files, entities, symbols, imports; resolution as ranked joins."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pattern import met
from ..shared import spread

# What is scanned, and the names that make a call a rendering, a sanitiser, a file operation or tainted.
EXTENSIONS = ("java", "py", "cs", "js", "kt", "kts", "html", "jinja2", "j2", "md", "markdown", "mdown", "mkd", "mdwn")
RENDERERS = ("render_template", "render_template_string", "TemplateResponse", "render")
SANITIZERS = ("escape", "html_escape", "sanitize", "sanitize_input", "clean", "bleach_clean")
SANITIZER_PREFIXES = ("sanitize_", "clean_", "escape_")
FILE_OPERATIONS = ("open", "join", "abspath", "realpath", "expanduser", "os.path.join", "os.path.abspath", "os.path.realpath", "os.path.expanduser", "pathlib.Path")
TAINTED = ("request.args", "request.form", "request.json", "request.data", "request.values", "request.files", "request.get_json")
#: Language -> what marks a path as a dependency's.
DEPENDENCY = {"py": "venv", "java": r"\.jar", "cs": "temp_deps_cs", "js": r"(^|/)node_modules(/|$)", "kt": r"build/|\.gradle/|/cache/", "kts": r"build/|\.gradle/|/cache/"}
#: Kind of a use -> relation.
RELATIONS = {"call": "CALLS", "base": "EXTENDS", "implements": "IMPLEMENTS", "return_type": "RETURNS", "parameters": "PARAMETERS"}

ROW = ["path", "kind", "name", "owner", "target", "line", "end", "doc"]
ROW_SCHEMA = "path string, kind string, name string, owner string, target string, line int, end int, doc string"
#: File extension -> function of (path, text) that gives the rows of a file; see :func:`register_analyzer`.
ANALYZERS: dict[str, Callable[[str, str], list[tuple]]] = {}


def register_analyzer(extension: str, rows: Callable[[str, str], list[tuple]]) -> None:
    """Files with this extension (without a dot) are analysed by ``rows``: tuples in the order of ``ROW``."""
    ANALYZERS[extension.lower()] = rows


def ignored(path, parts: list[str] | None = None, prefixes: list[str] | None = None, folders: list[str] | None = None) -> F.Column:
    """Whether a path contains one of ``parts``, starts with one of ``prefixes``, or has one of ``folders`` as a part (``*`` and ``/`` at its ends are dropped)."""
    found = F.lit(False)
    for part in parts or []:
        found = found | path.contains(part)
    for prefix in prefixes or []:
        found = found | path.startswith(prefix)
    for folder in folders or []:
        if name := folder.strip("*/"):
            found = found | F.array_contains(F.split(path, "/"), name)
    return found


def extension_of(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, text of the source files below ``root`` whose path contains none of ``ignore``; empty files have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.decode("content", "utf-8").alias("text"))
    return files.filter(extension_of(F.col("path")).isin(*EXTENSIONS) & ~ignored(F.col("path"), ignore))


def is_dependency(path) -> F.Column:
    """Whether a path belongs to a dependency, by the rule of its language (HTML and Markdown have none)."""
    found = F.lit(False)
    for extension, pattern in DEPENDENCY.items():
        found = F.when(extension_of(path) == extension, path.rlike(pattern)).otherwise(found)
    return found


def _leaf(node: ast.expr) -> str | None:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _dotted(node: ast.expr) -> str | None:
    """``a.b.c`` of a name or attribute; of a subscript what stands before it."""
    while isinstance(node, ast.Subscript):
        node = node.value
    if isinstance(node, ast.Constant) and isinstance(node.value, str):  # a type in quotes
        return node.value if re.fullmatch(r"[\w.]+", node.value) else None
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def parsed(text: str) -> ast.Module | None:
    """The syntax tree of a Python text; None if it does not parse or is nested too deeply for the parser."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def called_name(function: ast.expr) -> str | None:
    """``name`` or ``object.attribute`` of what is called; None for other expressions and for chains too deep to write out."""
    if isinstance(function, ast.Name):
        return function.id
    try:
        return f"{ast.unparse(function.value)}.{function.attr}" if isinstance(function, ast.Attribute) else None
    except RecursionError:
        return None


# kinds of nodes, as tuples that are made once
_DEFINITIONS, _ASSIGNMENTS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), (ast.Assign, ast.AnnAssign)


def children(node: ast.AST) -> list[ast.AST]:
    """The child nodes of a node that can have some themselves; constants and how a name is used are left out."""
    found: list[ast.AST] = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            found += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST) and not isinstance(value, (ast.expr_context, ast.Constant)):
            found.append(value)
    return found


def _source(lines: list[bytes], node: ast.expr) -> str:
    """The text of an expression."""
    a, b = node.lineno - 1, node.end_lineno - 1
    part = [lines[a][node.col_offset :], *lines[a + 1 : b], lines[b][: node.end_col_offset]] if a < b else [lines[a][node.col_offset : node.end_col_offset]]
    return b"\n".join(part).decode("utf-8", "replace")


def python_file(path: str, text: str) -> list[tuple]:
    """Definitions, uses and security facts of one Python file.

    Of a call ``name`` is the last attribute and ``target`` the text ``object.attribute``; imports have
    the dots of relative ones as owner; a doc is the text of a first statement that is an expression.
    A file that does not parse, or is nested too deeply for that, has no rows.
    """
    tree = parsed(text)
    if tree is None:
        return []
    lines = text.encode("utf-8", "replace").splitlines()
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while todo:
        node, owner, in_class = todo.pop()
        if isinstance(node, ast.Name):
            continue
        inner, is_class = owner, in_class
        at = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0)
        if isinstance(node, _DEFINITIONS):
            is_class = isinstance(node, ast.ClassDef)
            full = f"{owner}.{node.name}" if owner else node.name
            doc = _source(lines, node.body[0].value) if isinstance(node.body[0], ast.Expr) else None
            out.append((path, "class" if is_class else "method" if in_class else "function", node.name, owner, full, *at, doc))
            out += [(path, "decorator", _source(lines, d.func if isinstance(d, ast.Call) else d), full, None, d.lineno, d.lineno, None) for d in node.decorator_list]
            typed = [("base", b) for b in node.bases] if is_class else [("parameters", a.annotation) for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.annotation] + ([("return_type", node.returns)] if node.returns else [])
            out += [(path, kind, name.rpartition(".")[2], full, name, *at, None) for kind, t in typed if (name := _dotted(t))]
            inner = full
        elif isinstance(node, ast.Call) and (leaf := _leaf(node.func)):
            called = leaf if isinstance(node.func, ast.Name) else f"{_source(lines, node.func.value)}.{leaf}"
            out.append((path, "call", leaf, owner, called, *at, None))
            if owner and called in RENDERERS:
                out += [(path, "template_variable", k.arg, owner, called, *at, None) for k in node.keywords if k.arg]
            if owner and (called in SANITIZERS or called.startswith(SANITIZER_PREFIXES)):
                out.append((path, "sanitizer_call", called, owner, None, *at, None))
            if owner and called in FILE_OPERATIONS:
                given = " ".join(_source(lines, a) for a in (*node.args, *(k.value for k in node.keywords)))
                out.append((path, "fs_op", called, owner, "true" if any(x in given for x in TAINTED) else "false", *at, None))
        elif isinstance(node, ast.Import):
            out += [(path, "import", a.asname or a.name.partition(".")[0], "", a.name if a.asname else a.name.partition(".")[0], *at, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            dots = "." * node.level
            out.append((path, "module_import", None, dots, node.module or "", *at, None))
            out += [(path, "import", a.asname or a.name, dots, f"{node.module or ''}.{a.name}".strip("."), *at, None) for a in node.names]
        elif isinstance(node, _ASSIGNMENTS) and owner is None:
            out += [(path, "variable", t.id, None, t.id, *at, None) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
        todo += [(child, inner, is_class) for child in children(node)]
    return out


register_analyzer("py", python_file)


def analyzed(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """The rows of all files (path, text) with a registered extension; files that do not parse give none."""
    known = {k: f for k, f in ANALYZERS.items() if extensions is None or k in extensions}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, t, e in zip(batch["path"], batch["text"], batch["e"]) for r in known[e](p, t or "")], columns=ROW)

    found = files.select("path", "text", extension_of(F.col("path")).alias("e")).filter(F.col("e").isin(list(known)))
    return spread(found).mapInPandas(run, ROW_SCHEMA)


def python_rows(files: DataFrame) -> DataFrame:
    """Definitions and uses in Python files (path, text); files that do not parse give none."""
    return analyzed(files, ["py"])


def module_of(path) -> F.Column:
    """Dotted module of a path below the root; ``__init__`` stands for its package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def module_parts(path, root: str) -> F.Column:
    """The parts of a path's module below ``root``; null outside."""
    inside = F.regexp_replace(path, f"^\\Q{root.rstrip('/')}\\E/", "")
    return F.when(path.startswith(root.rstrip("/") + "/"), F.filter(F.split(module_of(inside), r"\."), lambda p: p != ""))


def absolute_import(path, dots, target, from_package: bool = False) -> F.Column:
    """The full dotted name of an import in the file ``path``; null if its dots climb above the root.

    The first dot stands for the package around the module.  With ``from_package`` it stands for the
    package itself in an ``__init__`` file, as names inside files are resolved; without, for the package
    around it and no climb ends above the root, as files are resolved.
    """
    parts = F.filter(F.split(module_of(path), r"\."), lambda p: p != "")
    level = F.length(F.coalesce(dots, F.lit("")))
    up = level - F.when(path.rlike(r"(^|/)__init__\.py$"), 1).otherwise(0) if from_package else F.least(level, F.size(parts))
    climbed = F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), F.nullif(target, F.lit("")))
    return F.when(level == 0, target).when(up <= F.size(parts), climbed)


def resolve_imports(rows: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """IMPORTS edges (src, dst paths) of Python files outside dependencies: the imported name, else its parent.

    Names are looked up as full module names, then as ends of such; of several files the first path wins.
    ``only`` (path) limits the importing files.
    """
    own = files.filter(F.col("path").endswith(".py") & ~is_dependency(F.col("path")))
    parts = F.split(module_of(F.col("path")), r"\.")
    ends = own.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("at", "dotted"))
    index = ends.filter("dotted <> ''").groupBy("dotted").agg(F.min(F.struct((F.col("at") > 0).alias("end"), "path")).alias("best")).select("dotted", F.col("best.path").alias("dst"))
    importing = rows.filter("kind in ('import', 'module_import')")
    asked = (importing if only is None else importing.join(only.select("path").distinct(), "path", "left_semi")).select(F.col("path").alias("src"), absolute_import(F.col("path"), F.col("owner"), F.coalesce(F.when(F.col("owner") == "", F.col("doc")), "target")).alias("target"))
    wanted = asked.filter("target <> ''").distinct().withColumn("parent", F.when(F.col("target").contains("."), F.regexp_replace("target", r"\.[^.]+$", "")))
    exact, above = index.select(F.col("dotted").alias("target"), F.col("dst").alias("d1")), index.select(F.col("dotted").alias("parent"), F.col("dst").alias("d2"))
    found = wanted.join(exact, "target", "left").join(above, "parent", "left").select("src", F.coalesce("d1", "d2").alias("dst"))
    return found.filter("dst is not null and src <> dst").distinct()


def resolve_uses(rows: DataFrame, kinds: dict[str, str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Edges (rel, src_path, src, dst_path, dst) of the uses of the given kinds (all) in Python files.

    Of a call only the last attribute counts, of types the dotted name.  In order: a top-level name of the
    same file; an imported one, where of the dotted name the longest part that is a module counts; a name
    that is unique among the project's top-level ones.  What follows a class's name must be its method.
    ``only`` (path) limits the files whose uses are resolved.
    """
    rel = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in (kinds or RELATIONS).items()))
    dotted = F.when(F.col("kind") == "call", F.col("name")).otherwise(F.coalesce("target", "name"))
    using = rows if only is None else rows.join(only.select("path").distinct(), "path", "left_semi")
    uses = using.withColumn("rel", rel).filter("rel is not null and owner is not null").select("rel", F.col("path").alias("src_path"), F.col("owner").alias("src"), dotted.alias("dotted")).distinct()
    uses = uses.filter(~is_dependency(F.col("src_path"))).withColumn("head", F.substring_index("dotted", ".", 1)).withColumn("tail", F.expr("substring(dotted, length(head) + 2)"))
    order = F.when(F.col("kind") == "variable", 1).otherwise(0)  # a variable does not hide a class or function
    tops = rows.filter("kind in ('class', 'function', 'variable') and owner is null").groupBy("path", "name").agg(F.min(F.struct(order.alias("o"), "kind")).alias("k")).select("path", "name", F.col("k.kind").alias("kind"), module_of(F.col("path")).alias("module"))
    methods = rows.filter("kind = 'method' and instr(owner, '.') = 0").select(F.col("path").alias("dst_path"), F.col("owner").alias("name2"), F.col("name").alias("tail")).distinct()
    home = lambda *keys: tops.select(*keys, F.col("kind").alias("dst_kind"))
    local = uses.join(home(F.col("path").alias("src_path"), F.col("name").alias("head")), ["src_path", "head"]).select("rel", "src_path", "src", "dotted", F.lit(1).alias("rank"), F.col("src_path").alias("dst_path"), F.col("head").alias("name2"), "dst_kind", "tail")
    imported = using.filter("kind = 'import'").select(F.col("path").alias("src_path"), F.col("name").alias("head"), absolute_import(F.col("path"), F.col("owner"), F.col("target"), True).alias("to")).filter("to is not null").distinct()
    full = uses.join(imported, ["src_path", "head"]).withColumn("parts", F.split(F.concat_ws(".", "to", F.nullif("tail", F.lit(""))), r"\."))
    cut = full.select("rel", "src_path", "src", "dotted", "parts", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("i")).filter("i < size(parts)")
    cut = cut.withColumn("module", F.array_join(F.expr("slice(parts, 1, i)"), ".")).withColumn("name2", F.expr("parts[i]")).withColumn("tail", F.array_join(F.expr("slice(parts, i + 2, size(parts))"), "."))
    by_import = cut.join(home("module", F.col("name").alias("name2"), F.col("path").alias("dst_path")), ["module", "name2"])
    longest = Window.partitionBy("rel", "src_path", "src", "dotted").orderBy(F.desc("i"), "dst_path")
    by_import = by_import.withColumn("n", F.row_number().over(longest)).filter("n = 1").select("rel", "src_path", "src", "dotted", F.lit(2).alias("rank"), "dst_path", "name2", "dst_kind", "tail")
    unique = tops.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("path").alias("dst_path"), F.min("kind").alias("dst_kind")).filter("c = 1")
    alone = uses.join(unique.withColumnRenamed("name", "head"), "head").select("rel", "src_path", "src", "dotted", F.lit(3).alias("rank"), "dst_path", F.col("head").alias("name2"), "dst_kind", "tail")
    ranked = local.unionByName(by_import).unionByName(alone).join(methods.withColumn("is_method", F.lit(True)), ["dst_path", "name2", "tail"], "left")
    whole = ranked.filter("tail = '' or (dst_kind = 'class' and is_method)").withColumn("dst", F.concat_ws(".", "name2", F.nullif("tail", F.lit(""))))
    best = Window.partitionBy("rel", "src_path", "src", "dotted").orderBy("rank", "dst_path")
    found = whole.withColumn("n", F.row_number().over(best)).filter("n = 1 and not (src_path = dst_path and src = dst)")
    return found.select("rel", "src_path", "src", "dst_path", "dst").distinct()


def template_links(variables: DataFrame, elements: DataFrame) -> DataFrame:
    """INJECTED_INTO: variables (path, name) and elements (path, name, start, refs) with the same name, in whatever files."""
    refs = elements.select(F.col("path").alias("element_path"), F.col("name").alias("element"), "start", F.explode("refs").alias("name"))
    return met(variables.select(F.col("path").alias("var_path"), "name").distinct(), refs, "name").select("name", "var_path", "element", "element_path", "start")


class _Elements(HTMLParser):
    """Elements in the order of their start tags: [name, label, start, end, refs]."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    REF = re.compile(r"\{\{\s*(\w+)\s*\}\}")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[list] = []
        self.open: list[tuple[str, list]] = []

    def _refer(self, text: str, also: tuple = ()) -> None:
        for name in self.REF.findall(text):
            for element in (*(e for _, e in self.open), *also):
                element[4].setdefault(name)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(reversed(attrs))
        row, text = [f"{tag}#{given['id']}" if given.get("id") else tag, "HtmlForm" if tag == "form" else "HtmlElement", self.getpos()[0], self.getpos()[0] + self.get_starttag_text().count("\n"), {}], self.get_starttag_text()
        self.found.append(row)
        for value in given.values():
            self._refer(value or "", (row,))
        if tag not in self.VOID and not text.endswith("/>"):
            self.open.append((tag, row))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                name, row = self.open.pop()
                row[3] = max(row[3], self.getpos()[0])
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        self._refer(data)


def html_rows(files: DataFrame) -> DataFrame:
    """files: path, text -> path, name (tag#id), label, start, end (lines from 1), refs of every element.

    refs are the bare words in ``{{ }}`` inside the element, its attributes and all that it contains.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                parser = _Elements()
                parser.feed(text or "")
                parser.close()
                last = (text or "").count("\n") + 1
                for _, row in parser.open:
                    row[3] = last
                out += [(path, *row[:4], list(row[4])) for row in parser.found]
            yield pd.DataFrame(out, columns=["path", "name", "label", "start", "end", "refs"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, label string, start int, end int, refs array<string>")


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, line, level, title, method, route of H2 and H3 headings, and their bullets (requirements)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    head = F.regexp_extract("text", r"^(#{2,3})\s+(.+?)\s*$", 1)
    marked = lines.withColumn("level", F.length(head)).withColumn("title", F.when(F.col("level") > 0, F.regexp_extract("text", r"^#{2,3}\s+(.+?)\s*$", 1)))
    marked = marked.withColumn("bullet", F.when(F.col("text").rlike(r"^\s*[-*+]\s+\S"), F.regexp_extract("text", r"^\s*[-*+]\s+(.+?)\s*$", 1)))
    at = F.last(F.when(F.col("level") > 0, F.col("line")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    parts = marked.withColumn("section", at).filter("section is not null and (level > 0 or bullet is not null)")
    route = r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*)"
    return parts.groupBy("path", "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.count("bullet").alias("n_requirements")).select(
        "path", F.col("section").alias("line"), "level", "title", F.nullif(F.upper(F.regexp_extract("title", route, 1)), F.lit("")).alias("method"), F.nullif(F.regexp_extract("title", route, 2), F.lit("")).alias("route"), "n_requirements"
    )


def html_tags(pages: DataFrame) -> DataFrame:
    """page_id, tag, n: opening tags of each page."""
    tags = F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t))
    return pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def lcov(reports: DataFrame) -> DataFrame:
    """reports: report (text of one record) -> file, found, hit, lines (array of line, hits), then
    test, the found and hit numbers of functions and branches (null if not given), functions (array of
    line, name), calls (array of name, hits) and branches (array of line, block, branch, hits; ``-`` is 0).
    """
    tag = lambda t: F.regexp_extract("report", rf"(?m)^{t}:(.*)$", 1)
    data = F.regexp_extract_all("report", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))
    number = lambda t: tag(t).try_cast("int").alias(t.lower())
    parts = lambda t, pattern, make: F.transform(F.regexp_extract_all("report", F.lit(rf"(?m)^{t}:({pattern})\r?$"), F.lit(1)), make)
    pick = lambda x, pattern, kind="int": F.regexp_extract(x, pattern, 1).try_cast(kind)
    return reports.filter(F.col("report").contains("SF:")).select(
        tag("SF").alias("file"), tag("LF").cast("int").alias("found"), tag("LH").cast("int").alias("hit"),
        F.transform(data, lambda d: F.struct(F.split(d, ",")[0].cast("int").alias("line"), F.split(d, ",")[1].cast("int").alias("hits"))).alias("lines"),
        tag("TN").alias("test"), *map(number, ("FNF", "FNH", "BRF", "BRH")),
        parts("FN", r"\d+,[^\r\n]*", lambda x: F.struct(pick(x, r"^(\d+)").alias("line"), pick(x, r"^\d+,(?:\d+,)?(.*)$", "string").alias("name"))).alias("functions"),
        parts("FNDA", r"\d+,[^\r\n]*", lambda x: F.struct(pick(x, r"^\d+,(.*)$", "string").alias("name"), pick(x, r"^(\d+)").alias("hits"))).alias("calls"),
        parts("BRDA", r"\d+,[^,\r\n]*,[^,\r\n]*,(?:\d+|-)", lambda x: F.struct(pick(x, r"^(\d+)").alias("line"), F.split(x, ",")[1].alias("block"), F.split(x, ",")[2].alias("branch"), F.coalesce(pick(x, r"(\d+|-)$"), F.lit(0)).alias("hits"))).alias("branches"),
    )


def lcov_reports(spark: SparkSession, path: str) -> DataFrame:
    """report: the records of all report files below a path; a large file is read in many splits, cut at the ends of records."""
    return spark.read.option("lineSep", "end_of_record").option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("report"))


def lcov_merged(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of :func:`lcov`, several a file where several tests ran -> files (file, found, hit) and lines (file, line, hits), hits added up."""
    lines = records.select("file", F.explode("lines").alias("l")).groupBy("file", F.col("l.line").alias("line")).agg(F.sum(F.col("l.hits").cast("long")).alias("hits"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("found"), F.sum((F.col("hits") > 0).cast("long")).alias("hit")), lines
