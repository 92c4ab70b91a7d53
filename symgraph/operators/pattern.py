"""Graph patterns as joins: expansion, optional match, anti join, coupling, symbol lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import scaled


def expand(edges: DataFrame, nodes: DataFrame, ids: list[int] | None = None, rels: list[str] | None = None, direction: str = "OUT", label: str | None = None) -> DataFrame:
    """One hop from ``ids``: origin, rel, direction, id, label, name, path; one row per edge."""
    if direction == "BOTH":
        return expand(edges, nodes, ids, rels, "OUT", label).unionByName(expand(edges, nodes, ids, rels, "IN", label))
    near, far = ("src", "dst") if direction == "OUT" else ("dst", "src")
    found = edges.filter(F.col("rel").isin(rels)) if rels else edges
    found = found.filter(F.col(near).isin(ids)) if ids is not None else found
    ends = nodes.filter(F.col("label") == label) if label else nodes
    return found.select(F.col(near).alias("origin"), "rel", F.lit(direction).alias("direction"), F.col(far).alias("id")).join(ends, "id").select("origin", "rel", "direction", "id", "label", "name", "path")


#: Rows of a key on one side that :func:`met` joins with so many of the other side in one part.
PART = 1024


def met(left: DataFrame, right: DataFrame, key: str, part: int = PART) -> DataFrame:
    """``left`` and ``right`` joined on ``key``, where single keys may have very many rows on both sides.

    A key's rows are dealt into parts of about ``part`` rows by a hash of the row, and each part of one side meets each of the
    other on its own, so that a product is spread over tasks and none holds more than two parts; a row is copied once for each
    part of the other side.  Only keys with more than a part are broadcast.  Columns must be of types that have a hash.  The
    number of tasks is fixed, as Spark would choose few by the bytes of the sides, which say nothing about their product.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    parts = lambda name: F.ceil(F.col(name) / part).cast("int")
    large = count(left, "_a").join(count(right, "_b").hint("merge"), key).select(key, parts("_a").alias("_m"), parts("_b").alias("_n")).filter("_m > 1 or _n > 1")

    def dealt(df: DataFrame, own: str, other: str, at: str, to: str) -> DataFrame:
        found = df.join(F.broadcast(large), key, "left")
        own_part = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        return found.select(*df.columns, own_part.alias(at), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(to))

    session = left.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    spread = lambda df: df.repartition(tasks, key, "_i", "_j")
    return spread(dealt(left, "_m", "_n", "_i", "_j")).join(spread(dealt(right, "_n", "_m", "_j", "_i")).hint("merge"), [key, "_i", "_j"]).drop("_i", "_j")


def neighbors(edges: DataFrame, nodes: DataFrame, ids: list[int], rels: list[str] | None = None, direction: str = "BOTH", limit: int | None = None) -> DataFrame:
    """Distinct (id, rel, direction) around ``ids``, in order of id."""
    found = expand(edges, nodes, ids, rels, direction).drop("origin").dropDuplicates(["id", "rel", "direction"])
    return found if limit is None else found.orderBy("id", "rel", "direction").limit(limit)


def dependencies(edges: DataFrame, nodes: DataFrame, ids: list[int], rels: list[str], limit: int = 50) -> DataFrame:
    """Outgoing neighbours, relations in the order given, at most ``limit`` in all."""
    rank = F.coalesce(*(F.when(F.col("rel") == r, F.lit(i)) for i, r in enumerate(rels)))
    return neighbors(edges, nodes, ids, rels, "OUT").withColumn("rank", rank).orderBy("rank", "id").limit(limit).drop("direction")


def collect_neighbors(edges: DataFrame, nodes: DataFrame, rel: str, direction: str = "OUT") -> DataFrame:
    """For each node its neighbours: n, names (sorted, one string), found (array of id, label, name, path)."""
    item = F.struct("name", "id", "label", "path")
    found = expand(edges, nodes, None, [rel], direction).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("found"))
    return found.select("origin", "n", F.array_join(F.col("found.name"), ",").alias("names"), "found")


def optional_match(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with each of its outgoing edges, or with nulls if it has none."""
    return nodes.join(edges, nodes["id"] == edges["src"], "left").select("id", "name", "rel", "dst")


def unreachable(nodes: DataFrame, edges: DataFrame, label: str, rel: str) -> DataFrame:
    """Nodes of a label that no edge of ``rel`` points at."""
    return nodes.filter(F.col("label") == label).join(edges.filter(F.col("rel") == rel).select(F.col("dst").alias("id")), "id", "left_anti")


def cross_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends have different, known paths: src, dst, rel, src_path, dst_path."""
    left, right = nodes.select(F.col("id").alias("src"), F.col("path").alias("src_path")), nodes.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    return edges.join(left, "src").join(right, "dst").filter("src_path <> dst_path").select("src", "dst", "rel", "src_path", "dst_path")


def file_coupling(edges: DataFrame, nodes: DataFrame, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Files by how often they touch a file: file, neighbour, n, ``REL:DIRECTION=count`` pairs; with ``limit`` of each
    file the first by n and path, and beside them total (neighbours in all) and truncated."""
    across = cross_file(edges, nodes)
    both = across.select(F.col("src_path").alias("file"), F.col("dst_path").alias("neighbour"), F.concat("rel", F.lit(":OUT")).alias("how")).unionByName(
        across.select(F.col("dst_path").alias("file"), F.col("src_path").alias("neighbour"), F.concat("rel", F.lit(":IN")).alias("how"))
    )
    both = both.filter(F.col("file") == path) if path else both
    counted = both.groupBy("file", "neighbour", "how").agg(F.count(F.lit(1)).alias("c"))
    pairs = counted.groupBy("file", "neighbour").agg(F.sum("c").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "how", "c"))), ",").alias("relations"))
    if limit is None:
        return pairs
    totals = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    best = Window.partitionBy("file").orderBy(F.desc("n"), "neighbour")
    first = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit).drop("_n")
    return first.join(totals, "file").withColumn("truncated", F.col("total") > limit)


def first_symbol(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """symbols: id, path, start, end -> path, id, start, end of the symbol with the least start (null last, then id) of each
    file, of ``files`` (path) only where given."""
    found = symbols.filter("path is not null")
    found = found if files is None else found.join(files.select("path"), "path", "left_semi")
    key = F.struct(F.col("start").isNull().alias("none"), F.col("start").alias("at"), "id", "end")
    return found.groupBy("path").agg(F.min(key).alias("k")).select("path", "k.id", F.col("k.at").alias("start"), "k.end")


def resolve_file(files: DataFrame, handle: str | int, relative=None) -> DataFrame:
    """files: id, path -> the file with that id, or with that path, as it is or as ``relative`` (a function of the column) makes it."""
    text = str(handle)
    found = F.col("path") == text
    if relative is not None:
        found = found | (relative(F.col("path")) == text)
    if text.isdigit():
        found = found | (F.col("id") == int(text))
    order = F.when(F.col("id").cast("string") == text, 0).otherwise(1)
    return files.filter(found).orderBy(order, "path", "id").limit(1)


def seek(nodes: DataFrame, **key) -> DataFrame:
    """Nodes whose columns have these values (null: is null)."""
    for column, value in key.items():
        nodes = nodes.filter(F.col(column).eqNullSafe(F.lit(value)))
    return nodes


def any_label(nodes: DataFrame, *labels: str) -> DataFrame:
    """nodes: labels (array), ... with one of the labels at least."""
    return nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))


MARKER = "Searchable"


def encoded(nodes: DataFrame) -> DataFrame:
    """nodes: id, labels (array) and properties -> id, labels without the marker, properties as one struct."""
    rest = [c for c in nodes.columns if c not in ("id", "labels")]
    return nodes.select("id", F.array_remove("labels", MARKER).alias("labels"), F.struct(*rest).alias("properties"))


def summary(nodes: DataFrame, relative=None, with_label: bool = True) -> DataFrame:
    """nodes: id, labels, name, path, start -> id, name, label (the first that is no marker), file, line."""
    label = [F.get(F.filter("labels", lambda x: x != MARKER), F.lit(0)).alias("label")] if with_label else []
    return nodes.select("id", "name", *label, (relative(F.col("path")) if relative else F.col("path")).alias("file"), F.col("start").alias("line"))


def centrality(edges: DataFrame, nodes: DataFrame, relative=None) -> DataFrame:
    """ln(1 + cross-file in-degree) of each file, scaled to 0..1 (all equal: 0).

    ``relative`` (a function of the path column) may give several paths one name: their logarithms are added.
    """
    named = relative or (lambda c: c)
    degree = cross_file(edges, nodes).groupBy(F.col("dst_path").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))
    files = nodes.filter("path is not null").select("path").distinct().join(degree, "path", "left").select(named(F.col("path")).alias("path"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    files = files.groupBy("path").agg(F.sum("in_degree").alias("in_degree"), F.sum(F.log1p("in_degree")).alias("raw"))
    bounds = files.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return files.join(F.broadcast(bounds)).select("path", "in_degree", F.bround(scaled("raw", "low", "high"), 4).alias("centrality"))  # bounds is one row


def find_symbol(nodes: DataFrame, name: str, file: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes called like the last dotted part of ``name``; those whose path is, ends in or contains ``file`` first."""
    simple = name.strip().rpartition(".")[2].strip()
    if not simple:
        raise ValueError(f"no symbol name: {name!r}")
    needle = (file or "").strip().lstrip("/")
    inside = F.coalesce(F.col("path").contains(needle), F.lit(False)) if needle else F.lit(False)
    order = [F.asc_nulls_last("start")] if "start" in nodes.columns else []
    return nodes.filter(F.col("name") == simple).withColumn("in_file", inside).orderBy(F.desc("in_file"), F.coalesce("path", F.lit("")), *order, "name", "id").limit(limit)


def find_symbols(nodes: DataFrame, wanted: DataFrame, limit: int = 20) -> DataFrame:
    """:func:`find_symbol` for many names at once; wanted: name, file.  Columns of the nodes, asked, in_file, n (the rank)."""
    asked = wanted.select(F.col("name").alias("asked"), F.ltrim(F.coalesce("file", F.lit("")), F.lit("/")).alias("needle"), F.substring_index(F.trim("name"), ".", -1).alias("name")).filter("name <> ''")
    found = nodes.join(asked, "name").withColumn("in_file", (F.col("needle") != "") & F.coalesce(F.contains("path", "needle"), F.lit(False)))
    order = Window.partitionBy("asked", "needle").orderBy(F.desc("in_file"), F.coalesce("path", F.lit("")), *([F.asc_nulls_last("start")] if "start" in nodes.columns else []), "id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select(*nodes.columns, "asked", "in_file", "n")


def prefix_search(nodes: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Nodes whose name, or a word of it, starts with ``prefix``, case ignored."""
    low = F.lit(prefix.lower())
    hit = F.lower("name").startswith(low) | F.exists(F.split(F.lower("name"), "[^a-z0-9_]+"), lambda w: w.startswith(low))
    return nodes.filter(hit).orderBy("name", "id").limit(limit)


def prefix_index(nodes: DataFrame, folder: str) -> None:
    """Writes token, name, id and the other columns of nodes: the whole name and its words in lower case, in the order of the tokens.

    Ranges of tokens lie together, so that a lookup reads only the files and row groups of its prefixes.
    """
    words = F.array_distinct(F.concat(F.array(F.lower("name")), F.split(F.lower("name"), "[^a-z0-9_]+")))
    tokens = nodes.select(F.explode(words).alias("token"), *nodes.columns).filter("token <> ''")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens.repartitionByRange(parts, "token", "name", "id").sortWithinPartitions("token").write.parquet(folder)


def prefix_lookup(spark: SparkSession, folder: str, prefixes: list[str], limit: int = 10) -> DataFrame:
    """:func:`prefix_search` for many prefixes at once over an index: prefix, n (the rank) and the nodes' columns.

    One join on the first letters, as many as the shortest prefix has; the ranges that these span reach the scan.
    """
    asked = sorted({p.lower() for p in prefixes} - {""})
    index = spark.read.parquet(folder)
    k = min(map(len, asked), default=1)
    keys = sorted({p[:k] for p in asked})
    after = lambda key: key + chr(0x10FFFF)  # noqa: E731 (no token that starts with the key is greater)
    inside = F.lit(False)
    for low, high in [(key, key) for key in keys] if len(keys) <= RANGES else [(keys[0], keys[-1])]:
        inside = inside | ((F.col("token") >= low) & (F.col("token") <= after(high)))
    wanted = F.broadcast(spark.createDataFrame([(p, p[:k]) for p in asked], "prefix string, first string"))  # the prefixes that were handed in
    found = index.filter(inside).join(wanted, F.substring("token", 1, k) == F.col("first")).filter(F.startswith("token", F.col("prefix"))).drop("token", "first")
    unique = found.dropDuplicates(["prefix", "name", "id"])
    best = Window.partitionBy("prefix").orderBy("name", "id")
    return unique.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit)


#: Ranges that are handed to a scan at most; more prefixes become one range.
RANGES = 200


def representative(nodes: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One node for each path: a wanted name first, then the least start (null last), name, end (null last) and id."""
    exact = F.coalesce(F.lower("name").isin([w.lower() for w in wanted]), F.lit(False)) if wanted else F.lit(False)
    place = lambda c: F.coalesce(F.col(c), F.lit(2_147_483_647)) if c in nodes.columns else F.lit(0)
    best = nodes.filter("path is not null").groupBy("path").agg(F.min(F.struct((~exact).alias("other"), place("start").alias("start"), "name", place("end").alias("end"), "id")).alias("r"))
    return best.select("path", "r.name", "r.id")


def members_per_class(classes: DataFrame, members: DataFrame, least: int = 0) -> DataFrame:
    """classes: id, name; members: owner.  Classes with their number of members, zeros included."""
    return classes.join(members, classes["id"] == members["owner"], "left").groupBy("id", "name").agg(F.count("owner").alias("n_methods")).filter(F.col("n_methods") >= least)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row for each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
