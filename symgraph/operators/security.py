"""Security rules over nodes and edges of a code graph, each one a small join plan.

nodes: id, label, name, path, line and props (map); edges: src, dst, rel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pattern import met


def _of(nodes: DataFrame, label: str, prefix: str) -> DataFrame:
    return nodes.filter(F.col("label") == label).select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "name", "path", "line", "props")))


def _link(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    return edges.filter(F.col("rel") == rel).select(F.col("src").alias(f"{src}_id"), F.col("dst").alias(f"{dst}_id"))


#: The ends of INJECTED_INTO (variables: src, name; elements: dst, name) where its edges are not among the edges.
Ends = tuple[DataFrame, DataFrame]


def _injected(variables: DataFrame, elements: DataFrame, edges: DataFrame, ends: Ends | None) -> DataFrame:
    """Variables with the elements that they are INJECTED_INTO, once both are down to the rows and columns that are asked."""
    if ends is None:
        return _link(edges, "INJECTED_INTO", "v", "e").join(elements, "e_id").join(variables, "v_id")
    given, refs = ends
    left = variables.join(given.select(F.col("src").alias("v_id"), F.col("name").alias("_name")), "v_id")
    return met(left, elements.join(refs.select(F.col("dst").alias("e_id"), F.col("name").alias("_name")), "e_id"), "_name").drop("_name")


def xss(nodes: DataFrame, edges: DataFrame, ends: Ends | None = None) -> DataFrame:
    """Variables put into an element that no function processes."""
    processed = _link(edges, "PROCESSED_BY", "v", "f").join(_of(nodes, "Function", "f"), "f_id").select("v_id")
    variables = _of(nodes, "Variable", "v").join(processed, "v_id", "left_anti").select("v_id", "v_name", "v_path", "v_line")
    return _injected(variables, _of(nodes, "HtmlElement", "e").select("e_id", "e_name"), edges, ends).select(
        F.col("v_name").alias("UnsafeVariable"), F.col("e_name").alias("TargetElement"), F.col("v_path").alias("SourceFile"), F.col("v_line").alias("SourceLine")
    )


def auth_drift(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Documented routes with their unprotected handlers.

    A protected handler does not match, so its route still shows, without a handler; ``strict``
    leaves those routes out.
    """
    guarded = _link(edges, "HAS_DECORATOR", "f", "d").join(_of(nodes, "Decorator", "d").filter(F.col("d_name") == "login_required"), "d_id").select("f_id")
    handlers = _of(nodes, "Function", "f").withColumn("f_route", F.col("f_props")["route"])
    sections = _link(edges, "DEFINES_ROUTE", "s", "r").join(_of(nodes, "MarkdownSection", "s"), "s_id").join(_of(nodes, "Route", "r"), "r_id")
    if strict:
        protected = handlers.join(guarded, "f_id", "left_semi").select(F.col("f_route").alias("r_path"))
        sections = sections.join(protected, "r_path", "left_anti")
    open_handlers = handlers.join(guarded, "f_id", "left_anti")
    return sections.join(open_handlers, F.col("r_path") == F.col("f_route"), "left").select(
        F.col("s_name").alias("DocumentedSection"), F.col("r_path").alias("UnsecuredRoute"), F.col("r_name").alias("Method"),
        F.coalesce("f_name", F.lit("no handler found")).alias("HandlerFunction"), F.col("f_id").alias("HandlerSymbolId"),
    )


def path_traversal(nodes: DataFrame, edges: DataFrame, need_caller: bool = True) -> DataFrame:
    """File-system operations on request data, with their callers."""
    callers = _link(edges, "HAS_FS_OP", "f", "o").join(_of(nodes, "Function", "f"), "f_id")
    tainted = _of(nodes, "FileSystemOp", "o").filter(F.col("o_props")["tainted"] == "true")
    return tainted.join(callers, "o_id", "inner" if need_caller else "left").select(
        F.col("o_name").alias("Operation"), F.col("o_path").alias("SourceFile"), F.col("o_line").alias("SourceLine"), F.coalesce("f_name", F.lit("unknown")).alias("CallerFunction"), F.col("f_id").alias("CallerSymbolId")
    )


def cve(nodes: DataFrame, edges: DataFrame, package: str) -> DataFrame:
    """Functions that call into a package."""
    package_of = _link(edges, "BELONGS_TO", "x", "p").join(_of(nodes, "Package", "p").filter(F.col("p_name") == package), "p_id")
    called = _of(nodes, "ExternalFunction", "x").join(package_of, "x_id")
    return _link(edges, "CALLS", "f", "x").join(called, "x_id").join(_of(nodes, "Function", "f"), "f_id").select(
        F.col("f_name").alias("CallerFunction"), F.col("f_path").alias("CallerFile"), F.col("x_name").alias("VulnerableFunction"), F.col("x_props")["module"].alias("Module"), F.col("f_id").alias("CallerSymbolId")
    )


def template_vars(nodes: DataFrame, edges: DataFrame, element_file: str | None = None, ends: Ends | None = None) -> DataFrame:
    """Variables in elements and whether a function sanitises them."""
    by = _link(edges, "PROCESSED_BY", "v", "f").join(_of(nodes, "Function", "f"), "f_id").select("v_id", "f_name")
    variables = _of(nodes, "Variable", "v").join(by, "v_id", "left").select("v_id", "v_name", "v_path", "v_line", "f_name")
    elements = _of(nodes, "HtmlElement", "e").select("e_id", "e_name", "e_path", "e_line")
    out = _injected(variables, elements.filter(F.col("e_path").contains(element_file)) if element_file else elements, edges, ends)
    return out.select(
        F.col("v_name").alias("variable"), F.col("v_path").alias("var_src_file"), F.col("v_line").alias("var_src_line"), F.col("e_name").alias("element"), F.col("e_path").alias("element_file"),
        F.col("e_line").alias("element_line"), F.col("f_name").isNotNull().alias("sanitized"), F.col("f_name").alias("sanitizer"),
    )


def fs_ops(nodes: DataFrame, edges: DataFrame, tainted_only: bool = True) -> DataFrame:
    callers = _link(edges, "HAS_FS_OP", "f", "o").join(_of(nodes, "Function", "f"), "f_id")
    ops = _of(nodes, "FileSystemOp", "o").withColumn("tainted", F.coalesce(F.col("o_props")["tainted"] == "true", F.lit(False)))
    ops = ops.filter("tainted") if tainted_only else ops
    return ops.join(callers, "o_id", "left").select(F.col("o_name").alias("op"), "tainted", F.col("o_path").alias("src_file"), F.col("o_line").alias("src_line"), F.col("f_name").alias("caller"), F.col("f_id").alias("caller_symbol_id"))


def decorators(nodes: DataFrame, edges: DataFrame, function_id: int) -> DataFrame:
    return _link(edges, "HAS_DECORATOR", "f", "d").filter(F.col("f_id") == function_id).join(_of(nodes, "Decorator", "d"), "d_id").select(F.col("d_name").alias("name"), F.col("d_path").alias("src_file"), F.col("d_line").alias("src_line"))


def mark_vulnerability(nodes: DataFrame, edges: DataFrame, package: str, status: str = "vulnerable") -> DataFrame:
    """The nodes again, external functions of the package with ``props['status']``."""
    hit = _link(edges, "BELONGS_TO", "x", "p").join(_of(nodes, "Package", "p").filter(F.col("p_name") == package), "p_id").select(F.col("x_id").alias("id"), F.lit(True).alias("hit")).distinct()
    new = F.map_concat(F.map_filter("props", lambda k, _: k != "status"), F.create_map(F.lit("status"), F.lit(status)))
    return nodes.join(hit, "id", "left").withColumn("props", F.when(F.coalesce("hit", F.lit(False)), new).otherwise(F.col("props"))).drop("hit")


def scan(nodes: DataFrame, edges: DataFrame, package: str | None = None, rules: dict[str, Callable] | None = None) -> dict[str, DataFrame | str]:
    """All rules by name; a rule that cannot be planned gives its error text and stops no other."""
    found: dict[str, DataFrame | str] = {}
    chosen = rules or {"xss": xss, "auth_drift": auth_drift, "path_traversal": path_traversal, **({"cve": lambda n, e: cve(n, e, package)} if package else {})}
    for name, rule in chosen.items():
        try:
            found[name] = rule(nodes, edges)
        except Exception as error:  # one broken rule must not hide the others
            found[name] = str(error)
    return found
