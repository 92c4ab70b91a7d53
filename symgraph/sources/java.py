"""Resolution of Java types, methods and imports over the rows of :mod:`braces`: ranked joins.

Types are known by simple name, package and file; of several with one package and name the first path
counts.  A use is looked up in all ways at once, and the best rank stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .code import is_dependency

#: A hierarchy is followed so many levels up at most.
LEVELS = 32


def _last(column: str, sep: str = ".") -> F.Column:
    return F.substring_index(column, sep, -1)


def _before(column: str) -> F.Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_replace(F.when(F.col(column).contains("."), F.col(column)).otherwise(F.lit("")), r"\.[^.]*$", "")


def _units(rows: DataFrame) -> DataFrame:
    """path, package of every Java file."""
    package = rows.filter("kind = 'package'").groupBy("path").agg(F.min("name").alias("package"))
    return rows.select("path").distinct().join(package, "path", "left").select("path", F.coalesce("package", F.lit("")).alias("package"))


def _types(rows: DataFrame) -> DataFrame:
    """path, package, name, full (with outer types) of every type; one for each file and name."""
    found = rows.filter("kind in ('class', 'interface', 'enum')").groupBy("path", "name").agg(F.min(F.struct(F.length("target").alias("n"), "target")).alias("t"))
    return found.select("path", "name", F.col("t.target").alias("full")).join(_units(rows), "path")


def _imports(rows: DataFrame, how: str) -> DataFrame:
    return rows.filter((F.col("kind") == "import") & (F.col("owner") == how)).select("path", "name", F.col("target").alias("to"), "line")


class Index:
    """The tables that every lookup reads, each written once: rows, units, types, and one type for each package and name."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.units = written(_units(rows), "java-units")
        self.types = written(_types(rows), "java-types")
        self.target = self.types.select(F.col("path").alias("dst_path"), F.col("package").alias("p"), F.col("name").alias("simple"), F.col("full").alias("dst"))
        self.in_package = written(self.target.groupBy("p", "simple").agg(F.min(F.struct("dst_path", "dst")).alias("t")).select("p", "simple", "t.dst_path", "t.dst"), "java-packages")


def resolve_types(rows: DataFrame | Index, wanted: DataFrame) -> DataFrame:
    """wanted: path, type -> path, type, rank, n, dst_path, dst_name, dst: all matches of the best rank, n in their order.

    0 by its full name, 1 in the same file, 2 by an import, 3 in the same package, 4 in a package of which
    all is imported (the first such import), 5 anywhere by its simple name (every match).  Only what no other way
    finds is looked up anywhere, so a common name is not paired with all its uses.
    """
    index = rows if isinstance(rows, Index) else Index(rows)
    rows, target, in_package = index.rows, index.target, index.in_package
    asked = written(wanted.select("path", "type").distinct().withColumn("simple", _last("type")).withColumn("prefix", _before("type")).join(index.units, "path"), "java-asked")
    pick = lambda df, rank, order=F.lit(0): df.select("path", "type", "simple", F.lit(rank).alias("rank"), order.cast("long").alias("o"), "dst_path", "dst")
    one, whole = _imports(rows, "one"), _imports(rows, "all")
    imported = asked.join(one.select("path", F.col("name").alias("simple"), _before("to").alias("p"), _last("to").alias("to_name"), "line"), ["path", "simple"])
    found = (
        pick(asked.filter("prefix <> ''").withColumnRenamed("prefix", "p").join(in_package, ["p", "simple"]), 0)
        .unionByName(pick(asked.join(target.withColumnRenamed("dst_path", "path").withColumn("dst_path", F.col("path")), ["path", "simple"]), 1))
        .unionByName(pick(imported.withColumn("own", F.col("simple")).drop("simple").withColumnRenamed("to_name", "simple").join(in_package, ["p", "simple"]).drop("simple").withColumnRenamed("own", "simple"), 2, F.col("line")))
        .unionByName(pick(asked.withColumnRenamed("package", "p").join(in_package, ["p", "simple"]), 3))
        .unionByName(pick(asked.join(whole.select("path", F.col("to").alias("p"), "line"), "path").join(in_package, ["p", "simple"]), 4, F.col("line")))
    )
    found = written(found, "java-found")
    found = found.unionByName(pick(asked.join(found.select("path", "type").distinct(), ["path", "type"], "left_anti").join(target.drop("p"), "simple"), 5))
    best = Window.partitionBy("path", "type")
    order = best.orderBy("o", "dst_path", "dst")
    kept = found.withColumn("least", F.min("rank").over(best)).filter("rank = least").withColumn("n", F.row_number().over(order)).filter("rank = 5 or n = 1")
    return kept.select("path", "type", "rank", "n", "dst_path", F.col("simple").alias("dst_name"), "dst")


def type_edges(rows: DataFrame) -> DataFrame:
    """EXTENDS, IMPLEMENTS, PARAMETERS, RETURNS edges: rel, src_path, src, dst_path, dst."""
    rel = F.create_map(*(F.lit(x) for x in ("base", "EXTENDS", "implements", "IMPLEMENTS", "parameters", "PARAMETERS", "return_type", "RETURNS")))
    uses = rows.filter(F.col("kind").isin("base", "implements", "parameters", "return_type") & ~is_dependency(F.col("path"))).select(rel[F.col("kind")].alias("rel"), "path", F.col("owner").alias("src"), F.col("target").alias("type"))
    found = uses.join(resolve_types(rows, uses), ["path", "type"])
    return found.select("rel", F.col("path").alias("src_path"), "src", "dst_path", "dst").filter("not (src_path = dst_path and src = dst)").distinct()


def _ancestors(index: Index, starts: DataFrame) -> DataFrame:
    """starts: path, name of types -> path, name, way, at_path, at_name: the types themselves and all above, way in the order
    of search: a type, all above its superclass, then all above its interfaces."""
    kinds = index.rows.filter("kind in ('base', 'implements')")
    direct = kinds.select("path", _last("owner").alias("name"), F.col("target").alias("type"), (F.col("kind") == "implements").cast("int").alias("iface"), F.monotonically_increasing_id().alias("n_use"))
    direct = written(direct, "java-direct")
    to = resolve_types(index, direct).filter("n = 1")
    numbered = Window.partitionBy("path", "name").orderBy("iface", "n_use")
    up = written(direct.join(to, ["path", "type"]).withColumn("step", F.row_number().over(numbered)).select(F.col("path").alias("at_path"), F.col("name").alias("at_name"), "step", F.col("dst_path").alias("up_path"), F.col("dst_name").alias("up_name")), "java-up")
    level = written(starts.select("path", "name", F.array().cast("array<int>").alias("way"), F.col("path").alias("at_path"), F.col("name").alias("at_name"), F.array("name").alias("seen")).distinct(), "java-level")
    out = level
    for _ in range(LEVELS):
        above = level.join(up, ["at_path", "at_name"]).filter(~F.array_contains("seen", F.col("up_name")))
        level = written(above.select("path", "name", F.array_append("way", F.col("step")).alias("way"), F.col("up_path").alias("at_path"), F.col("up_name").alias("at_name"), F.array_append("seen", F.col("up_name")).alias("seen")), "java-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("seen")


def call_edges(rows: DataFrame) -> DataFrame:
    """CALLS edges of Java files: rel, src_path, src, dst_path, dst.

    In order: a method of the receiver's type or of a type above it, where the receiver is the enclosing
    type, its superclass, a type by name, a parameter or local variable, or a field; a static import of the
    name; a class of which all is statically imported; the only method of that name; those of the same
    package or of imported classes; all of that name.
    """
    index = Index(rows)
    methods = rows.filter("kind in ('method', 'constructor')").select(F.col("path").alias("dst_path"), _last("owner").alias("dst_class"), "name", F.col("target").alias("dst")).join(index.units.withColumnRenamed("path", "dst_path"), "dst_path").distinct()
    methods = written(methods, "java-methods")
    calls = rows.filter("kind = 'call'").filter(~is_dependency(F.col("path"))).select("path", F.col("owner").alias("src"), "name", F.coalesce("target", F.lit("this")).alias("given")).distinct()
    receiver = F.when(F.col("given").startswith("this."), F.substring("given", 6, 1000)).otherwise(F.col("given"))
    calls = written(calls.withColumn("receiver", receiver).withColumn("type", F.substring_index(F.regexp_replace("src", r"\.[^.]*$", ""), ".", -1)), "java-calls")
    supers = rows.filter("kind = 'base'").groupBy("path", _last("owner").alias("type")).agg(F.min("target").alias("to"))
    named = calls.filter("given not in ('this', 'super')")
    by_type = named.join(resolve_types(index, named.select("path", F.col("receiver").alias("type"))).filter("n = 1").select("path", F.col("type").alias("receiver"), F.col("dst_name").alias("to")), ["path", "receiver"])
    declared = lambda kind: rows.filter(F.col("kind") == kind).groupBy("path", F.col("owner").alias("place"), F.col("name").alias("receiver")).agg(F.min_by("target", "line").alias("to"))
    local = named.join(declared("local").withColumnRenamed("place", "src"), ["path", "src", "receiver"])
    fields = declared("field").withColumn("type", _last("place")).drop("place")
    field = named.join(fields, ["path", "type", "receiver"])
    columns = ["path", "src", "name", "given"]
    receivers = calls.filter("given = 'this'").select(*columns, F.col("type").alias("to"), F.lit(0).alias("by")).unionByName(calls.filter("given = 'super'").join(supers, ["path", "type"]).select(*columns, "to", F.lit(0).alias("by")))
    for by, part in enumerate((by_type, local, field), 1):
        receivers = receivers.unionByName(part.select(*columns, "to", F.lit(by).alias("by")))
    first = Window.partitionBy(*columns).orderBy("by", "to")
    receivers = receivers.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*columns, "to", F.lit(1).alias("rank"), F.lit(0).alias("o"))
    static_one = calls.join(_imports(rows, "static one").select("path", "name", _last_of_parent("to").alias("to"), F.col("line").alias("o")), ["path", "name"]).select(*columns, "to", F.lit(2).alias("rank"), "o")
    static_all = calls.join(_imports(rows, "static all").select("path", _last("to").alias("to"), F.col("line").alias("o")), "path").select(*columns, "to", F.lit(3).alias("rank"), "o")
    through = written(receivers.unionByName(static_one).unionByName(static_all), "java-receivers")
    homes = resolve_types(index, through.select("path", F.col("to").alias("type"))).filter("n = 1").select("path", F.col("type").alias("to"), F.col("dst_path").alias("home"), F.col("dst_name").alias("home_name"))
    homes = written(homes, "java-homes")
    above = _ancestors(index, homes.select(F.col("home").alias("path"), F.col("home_name").alias("name")).distinct()).select(F.col("path").alias("home"), F.col("name").alias("home_name"), "way", F.col("at_path").alias("dst_path"), F.col("at_name").alias("dst_class"))
    inherited = through.join(homes, ["path", "to"]).join(above, ["home", "home_name"]).join(methods.drop("package"), ["dst_path", "dst_class", "name"])
    order = lambda rank: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("o"), F.array().cast("array<int>").alias("way")).alias("order")
    ranked = written(inherited.select(*columns, F.struct("rank", "o", "way").alias("order"), "dst_path", "dst"), "java-inherited")
    # what a receiver or a static import does not resolve is looked up by name, each way only for what is left by the one before
    left = lambda asked, by: asked.join(by.select(*columns).distinct(), columns, "left_anti")
    rest = written(left(calls.select(*columns), ranked).join(index.units, "path"), "java-rest")
    alone = methods.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("dst_path").alias("dst_path"), F.min("dst").alias("dst")).filter("c = 1").drop("c")
    only = rest.join(alone, "name").select(*columns, order(4), "dst_path", "dst")
    rest = written(left(rest, only), "java-rest")
    known = _imports(rows, "one").select("path", F.col("name").alias("dst_class")).distinct()
    near = rest.join(methods, ["package", "name"]).select(*columns, "dst_path", "dst").unionByName(rest.join(known, "path").join(methods.drop("package"), ["dst_class", "name"]).select(*columns, "dst_path", "dst"))
    near = written(near.distinct().select(*columns, order(5), "dst_path", "dst"), "java-near")
    anywhere = left(rest, near).join(methods.select("name", "dst_path", "dst"), "name").select(*columns, order(6), "dst_path", "dst")
    ranked = ranked.unionByName(only).unionByName(near).unionByName(anywhere)
    kept = ranked.withColumn("least", F.min("order").over(Window.partitionBy(*columns))).filter("order = least")
    return kept.select(F.lit("CALLS").alias("rel"), F.col("path").alias("src_path"), "src", "dst_path", "dst").filter("not (src_path = dst_path and src = dst)").distinct()


def _last_of_parent(column: str) -> F.Column:
    """The last part but one of a dotted name; the name itself without a dot."""
    return F.when(F.col(column).contains("."), F.substring_index(F.substring_index(column, ".", -2), ".", 1)).otherwise(F.col(column))


def import_edges(rows: DataFrame) -> DataFrame:
    """IMPORTS edges (src, dst paths): a class, all of a package, a class's static member, all static members of a class."""
    tops = _types(rows).filter("full = name").select(F.col("path").alias("dst"), F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")).alias("to"))
    units = _units(rows).filter("package <> ''").select(F.col("path").alias("dst"), F.col("package").alias("to"))
    by = lambda how, key, targets: _imports(rows, how).select(F.col("path").alias("src"), key.alias("to")).join(targets, "to").select("src", "dst")
    parent = F.when(F.col("to").contains("."), _before("to")).otherwise(F.col("to"))
    found = by("one", F.col("to"), tops).unionByName(by("all", F.col("to"), units)).unionByName(by("static one", parent, tops)).unionByName(by("static all", F.col("to"), tops))
    return found.filter("src <> dst").distinct()
