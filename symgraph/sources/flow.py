"""Data flow inside Python functions, as rows: what a variable is made of, what a template is given.

``flow_rows`` only reads one file at a time; which value reaches which template or sanitiser is a join of
these rows within a function (see :mod:`securitypass`).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .code import RENDERERS, _leaf, called_name, children, extension_of, parsed

#: The last part of a decorator that gives its function a route, and the method each one means.
ROUTE_METHODS = {"route": "GET", "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "head": "HEAD", "options": "OPTIONS"}

# kinds of nodes, as tuples that are made once
_DEFINITIONS, _ASSIGNMENTS, _LOOPS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr), (ast.For, ast.AsyncFor, ast.comprehension)
#: Last parts of the names of renderers: of other calls the whole name is not written out.
_LAST = {r.rpartition(".")[2] for r in RENDERERS}

FLOW = ["path", "owner", "kind", "name", "target", "line"]
FLOW_SCHEMA = "path string, owner string, kind string, name string, target string, line int"


def _used(value: ast.expr) -> tuple[list[str], list[str]]:
    """Variables that an expression reads and functions that it calls, names of called functions not among the variables."""
    called = [n.func for n in ast.walk(value) if isinstance(n, ast.Call)]
    skipped = {id(f) for f in called}
    names = [n.id for n in ast.walk(value) if isinstance(n, ast.Name) and id(n) not in skipped]
    return list(dict.fromkeys(names)), list(dict.fromkeys(t for f in called if (t := called_name(f))))


def _targets(target: ast.expr) -> list[str]:
    """Variables that an assignment to ``target`` sets; of attributes and items the variable they belong to."""
    while isinstance(target, ast.Attribute | ast.Subscript | ast.Starred):
        target = target.value
    if isinstance(target, ast.Tuple | ast.List):
        return [name for t in target.elts for name in _targets(t)]
    return [target.id] if isinstance(target, ast.Name) else []


def python_flow(path: str, text: str) -> list[tuple]:
    """Rows of one file, by function (``owner``, dotted).

    ``assign``: variable name is made of variable target; ``assign_call``: of what function target gives;
    ``render`` and ``render_call``: the same for the keyword name that a template gets; ``route``: the
    function's route is name, by method target.  A file that does not parse has none.
    """
    tree = parsed(text)
    if tree is None:
        return []
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while todo:
        node, owner, inside = todo.pop()
        if isinstance(node, ast.Name):
            continue
        below, in_function = owner, inside
        line = getattr(node, "lineno", 0)
        if isinstance(node, _DEFINITIONS):
            below = f"{owner}.{node.name}" if owner else node.name
            in_function = not isinstance(node, ast.ClassDef)
            for d in node.decorator_list if in_function else []:
                method = ROUTE_METHODS.get(d.func.attr) if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) else None
                if method and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    out.append((path, below, "route", d.args[0].value, method, d.lineno))
        given: list[tuple[str, str, ast.expr]] = []
        if inside and isinstance(node, _ASSIGNMENTS) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            given = [("assign", name, node.value) for t in targets for name in _targets(t)]
        elif inside and isinstance(node, _LOOPS):
            given = [("assign", name, node.iter) for name in _targets(node.target)]
        elif inside and isinstance(node, ast.withitem) and node.optional_vars is not None:
            given = [("assign", name, node.context_expr) for name in _targets(node.optional_vars)]
        elif inside and isinstance(node, ast.Call) and _leaf(node.func) in _LAST and called_name(node.func) in RENDERERS:
            given = [("render", k.arg, k.value) for k in node.keywords if k.arg]
        for kind, name, value in given:
            names, called = _used(value)
            at = line or getattr(value, "lineno", 0)
            out += [(path, owner, kind, name, x, at) for x in names] + [(path, owner, f"{kind}_call", name, x, at) for x in called]
        todo += [(child, below, in_function) for child in children(node)]
    return out


def flow_rows(files: DataFrame) -> DataFrame:
    """files: path, text -> the rows of :func:`python_flow` of all Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, t in zip(batch["path"], batch["text"]) for r in python_flow(p, t or "")], columns=FLOW)

    return files.filter(extension_of(F.col("path")) == "py").select("path", "text").mapInPandas(run, FLOW_SCHEMA)
