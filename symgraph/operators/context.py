"""What a specification of an entity should know: methods, callees, guards, file operations, requirements.

nodes: id, label, name, path, doc; edges: src, dst, rel.  Everything is found for many entities at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The guards, what is left out of the candidates, and the sizes of a context.
GUARDS = ("login_required", "token_required", "public_or_auth")
NOISE = ("/build/", "/dist/", "/.venv/", "/venv/", "/node_modules/", "/site-packages/", "/repositories/", "/ripwire/test/", "/ripwire/bench/", "/tests/source_files/", "/tests/mcp/fixtures/")
NOISE_NAMES = ("Test", "test_")
MOST = {"methods": 20, "calls": 10, "auth": None, "fs_ops": 10, "requirements": 20}
LONGEST, LONGEST_DOC = 3000, 120
#: In this order a name is looked for: label, column, whether the whole value must be equal.
CASCADE = (("Class", "name", True), ("Class", "name", False), ("File", "name", False), ("File", "path", False), ("Route", "path", False), ("Decorator", "name", False), ("MarkdownSection", "name", True), ("MarkdownSection", "name", False))


def is_noise(name: str = "name", path: str = "path") -> F.Column:
    """Build results, dependencies, fixtures and test classes."""
    found = F.lit(False)
    for part in NOISE:
        found = found | F.coalesce(F.col(path), F.lit("")).contains(part)
    for prefix in NOISE_NAMES:
        found = found | F.coalesce(F.col(name), F.lit("")).startswith(prefix)
    return found


def candidates(classes: DataFrame, members: DataFrame, least: int = 0) -> DataFrame:
    """classes: id, name, path, doc; members: owner -> name, path, n_methods, slug, recommended (three methods or more, and a doc).

    Noise is left out; of classes with the same name and path the one with most methods stays (then the least id).
    """
    counted = classes.filter(~is_noise()).join(members, classes["id"] == members["owner"], "left").groupBy("id", "name", "path", "doc").agg(F.count("owner").alias("n_methods"))
    first = Window.partitionBy("name", "path").orderBy(F.desc("n_methods"), "id")
    kept = counted.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) & (F.col("n_methods") >= least))
    described = F.length(F.coalesce("doc", F.lit(""))) > 0
    return kept.select("name", "path", "n_methods", F.replace(F.lower("name"), F.lit("_"), F.lit("-")).alias("slug"), ((F.col("n_methods") >= 3) & described).alias("recommended"))


#: Names or entities that may be asked for at once: they are broadcast.
MOST_ASKED = 10_000


def _asked(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast; ValueError if it has more rows than may be asked for."""
    if df.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} names or entities at once")
    return F.broadcast(df)


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: capability -> capability, rank, id, label, name, path, doc: the first match of the cascade, then the least id.

    Parts of names have no key to join on, so every node is held against every asked name, of which there may be ``MOST_ASKED``.
    """
    asked = _asked(wanted)
    ranked = None
    for rank, (label, column, whole) in enumerate(CASCADE, 1):
        value = F.coalesce(F.col(column), F.lit(""))
        some = nodes.filter(F.col("label") == label)
        hit = (value == F.col("capability")) if whole else value.contains(F.col("capability"))
        found = some.join(asked, hit).select("capability", F.lit(rank).alias("rank"), "id", "label", "name", "path", "doc")  # wanted: the names that a user asks for
        ranked = found if ranked is None else ranked.unionByName(found)
    best = F.min(F.struct("rank", "id", "label", "name", "path", "doc")).alias("r")
    return ranked.groupBy("capability").agg(best).select("capability", "r.*")


def items(nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """entities: id, label, capability -> id, section, n, item, doc: the first items by name of each section.

    A class speaks through the functions that it defines; requirements are those of a section itself, for
    other entities of the sections whose path contains the capability.
    """
    link = lambda rel: edges.filter(F.col("rel") == rel).select("src", "dst")
    of = lambda label: nodes.filter(F.col("label") == label).select(F.col("id").alias("dst"), F.col("name").alias("item"), "doc")
    classes = entities.filter("label = 'Class'")
    methods = classes.select(F.col("id").alias("src")).join(link("DEFINES"), "src").join(of("Function"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("via"), "item", "doc")
    speakers = methods.select("id", "via").unionByName(entities.filter("label <> 'Class'").select("id", F.col("id").alias("via")))
    targets = lambda rel, ends: speakers.join(link(rel), F.col("via") == F.col("src")).join(ends, "dst").filter("item is not null").select("id", "item").distinct()
    anything = nodes.select(F.col("id").alias("dst"), F.col("name").alias("item"))
    sections = {
        "methods": methods.select("id", "item", "doc"),
        "calls": targets("CALLS", anything),
        "auth": targets("HAS_DECORATOR", of("Decorator").filter(F.col("item").isin(*GUARDS)).drop("doc")),
        "fs_ops": targets("HAS_FS_OP", of("FileSystemOp").drop("doc")),
    }
    required = link("DEFINES_REQUIREMENT").join(of("Requirement").drop("doc"), "dst").select("src", "item")
    places = nodes.filter("label = 'MarkdownSection'").select(F.col("id").alias("src"), F.col("path").alias("section_path"))
    others = _asked(entities.filter("label <> 'MarkdownSection'").select("id", "capability"))  # the entities that a user asks for
    by_path = required.join(places, "src").join(others, F.col("section_path").contains(F.col("capability"))).select("id", "item")
    sections["requirements"] = entities.filter("label = 'MarkdownSection'").select("id").join(required, F.col("id") == F.col("src")).select("id", "item").unionByName(by_path)
    out = None
    for name, found in sections.items():
        order = Window.partitionBy("id").orderBy("item")
        rows = found.withColumn("n", F.row_number().over(order))
        rows = rows.filter(F.col("n") <= MOST[name]) if MOST[name] else rows
        rows = rows.select("id", F.lit(name).alias("section"), "n", "item", (F.col("doc") if name == "methods" else F.lit(None).cast("string")).alias("doc"))
        out = rows if out is None else out.unionByName(rows)
    return out


def texts(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entities: id, label, name, path, doc; found: :func:`items` -> id, context: a text of 3000 characters at most."""
    lists = found.groupBy("id").agg(*(F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("n", "item", "doc")))).alias(s) for s in MOST))
    rows = entities.join(lists, "id", "left")

    def part(title: str, section: str, line) -> F.Column:
        shown = F.array_join(F.transform(F.coalesce(section, F.array().cast("array<struct<n:int,item:string,doc:string>>")), line), "\n")
        return F.concat(F.lit(f"[{title}]\n"), F.when(shown == "", F.lit("  (none)")).otherwise(shown))

    documented = lambda x: F.concat(F.lit("  "), x["item"], F.when(F.coalesce(x["doc"], F.lit("")) != "", F.concat(F.lit(": "), F.substring(x["doc"], 1, LONGEST_DOC))).otherwise(F.lit("")))
    marked = lambda mark: lambda x: F.concat(F.lit(f"  {mark}"), x["item"])
    head = F.concat(F.lit("[CAPABILITY]\nName: "), F.coalesce("name", F.lit("")), F.lit("\nFile: "), F.coalesce("path", F.lit("")), F.lit("\nType: "), "label")
    doc = F.concat(F.lit("[DOCSTRING]\n"), F.coalesce(F.nullif("doc", F.lit("")), F.lit("(none)")))
    whole = F.concat_ws("\n\n", head, doc, F.when(F.col("label") == "Class", part("PUBLIC METHODS", "methods", documented)), part("CALLS", "calls", marked("-> ")), part("AUTH", "auth", marked("")), part("FS_OPS", "fs_ops", marked("")), part("EXISTING REQUIREMENTS", "requirements", marked("- ")))
    return rows.select("id", F.when(F.length(whole) > LONGEST, F.concat(F.substring(whole, 1, LONGEST - 3), F.lit("…"))).otherwise(whole).alias("context"))
