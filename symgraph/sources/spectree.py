"""Spec trees: capabilities, requirements, scenarios, tasks and requirement changes as tables.

Each function takes files (path, text) and numbers lines from 1.  All of it is windows over the
lines of one file: which heading a line stands under is the last heading before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# The lines of the file format, as its documents have them.
BOX = r"^\s*-\s+\[([ xX])\]\s+(.+)$"
SECTION = r"^##\s+(.+)$"
REQUIREMENT = r"^###\s+Requirement:\s+(.+)$"
SCENARIO = r"^####\s+Scenario:\s+(.+)$"
STEP = r"(?i)^\s*-\s+\*\*(GIVEN|WHEN|THEN|AND)\*\*\s*(.*)$"
CHANGE = r"(?i)^##\s+(ADDED|MODIFIED|REMOVED|RENAMED)\s+Requirements?"
RENAME = r"^-\s+{side}:\s+`###\s+Requirement:\s+(.+?)`"
NUMBER = r"^(\d+(?:\.\d+)*)\s+"
#: Folders whose changes are done with.
ARCHIVE = "archive"
#: Relation of a change to a requirement, by the section that names it.
RELATION = {"ADDED": "CHANGE_ADDS_REQUIREMENT", "MODIFIED": "CHANGE_MODIFIES_REQUIREMENT", "REMOVED": "CHANGE_REMOVES_REQUIREMENT", "RENAMED": "CHANGE_MODIFIES_REQUIREMENT"}


def _so_far(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def specs(files: DataFrame) -> DataFrame:
    """The specifications of the capabilities, with the folder as ``name``."""
    return _named(files, r"(?:^|/)openspec/specs/([^/]+)/spec\.md$")


def change_tasks(files: DataFrame) -> DataFrame:
    """The task lists of the open changes, with the change as ``name``."""
    return _named(files, r"(?:^|/)openspec/changes/([^/]+)/tasks\.md$").filter(F.col("name") != ARCHIVE)


def change_specs(files: DataFrame) -> DataFrame:
    """The specifications inside the open changes, with the change as ``name`` and the ``capability``."""
    where = r"(?:^|/)openspec/changes/([^/]+)/specs/([^/]+)/spec\.md$"
    return _named(files, where).withColumn("capability", F.regexp_extract("path", where, 2)).filter(F.col("name") != ARCHIVE)


def changes(files: DataFrame) -> DataFrame:
    """The open changes: path (of their metadata file), name, and created, schema, skip_specs where they are given."""
    found = _named(files, r"(?:^|/)openspec/changes/([^/]+)/\.openspec\.yaml$").filter(F.col("name") != ARCHIVE)
    keys = metadata(found)
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    given = keys.groupBy("path").agg(value("created"), value("schema"), value("skip_specs"))
    return found.select("path", "name").join(given, "path", "left")


def metadata(files: DataFrame) -> DataFrame:
    """path, key, value of the ``key: value`` lines of files; of a repeated key the last line counts, other lines are ignored."""
    pairs = _lines(files).filter(F.col("text").contains(":")).select("path", "line", F.trim(F.substring_index("text", ":", 1)).alias("key"), F.trim(F.expr("substring(text, instr(text, ':') + 1)")).alias("value"))
    last = pairs.groupBy("path", "key").agg(F.max_by("value", "line").alias("value"))
    return last.withColumn("value", F.regexp_replace("value", "^([\"'])(.*)\\1$", "$2"))


def _named(files: DataFrame, where: str) -> DataFrame:
    return files.filter(F.col("path").rlike(where)).withColumn("name", F.regexp_extract("path", where, 1))


def _lines(files: DataFrame) -> DataFrame:
    each = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "raw"))
    return each.select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace("raw", r"\s+$", "").alias("text"))


def _part(pattern: str, group: int = 1) -> Column:
    """A group of the pattern in the line, trimmed; null where the line does not match."""
    return F.when(F.col("text").rlike(pattern), F.trim(F.regexp_extract("text", pattern, group)))


def _joined(when: Column, what: str, between: str) -> Column:
    """The values of the lines for which ``when`` holds, in the order of the lines."""
    listed = F.sort_array(F.collect_list(F.when(when, F.struct("line", F.col(what).alias("_v")))))
    return F.trim(F.array_join(F.transform(listed, lambda x: x["_v"]), between))


def tasks(files: DataFrame) -> DataFrame:
    """path, line, group (heading above), num (``1.2``, or empty), text, checked of check boxes."""
    marked = _lines(files).withColumn("group", F.coalesce(F.last(_part(SECTION), ignorenulls=True).over(_so_far("path")), F.lit(""))).filter(F.col("text").rlike(BOX))
    what = _part(BOX, 2)
    num = F.regexp_extract(what, NUMBER, 1)
    return marked.select("path", "line", "group", num.alias("num"), F.when(num != "", F.trim(F.regexp_replace(what, NUMBER, ""))).otherwise(what).alias("text"), (F.lower(F.regexp_extract("text", BOX, 1)) == "x").alias("checked"))


def _marked(files: DataFrame) -> DataFrame:
    """Lines with the section, requirement line and scenario line (0: none) that they stand under."""
    section = _part(SECTION)
    marked = _lines(files).withColumn("heading", section).withColumn("purpose", F.coalesce(F.lower(F.last(section, ignorenulls=True).over(_so_far("path"))) == "purpose", F.lit(False)))
    marked = marked.withColumn("requirement", F.when(~F.col("purpose"), _part(REQUIREMENT)))
    marked = marked.withColumn("req_line", F.coalesce(F.last(F.when(F.col("heading").isNotNull(), 0).when(F.col("requirement").isNotNull(), F.col("line")), ignorenulls=True).over(_so_far("path")), F.lit(0)))
    marked = marked.withColumn("scenario", F.when(F.col("req_line") > 0, _part(SCENARIO)))
    stop = F.when(F.col("heading").isNotNull() | F.col("requirement").isNotNull(), 0).when(F.col("scenario").isNotNull(), F.col("line"))
    return marked.withColumn("scen_line", F.coalesce(F.last(stop, ignorenulls=True).over(_so_far("path")), F.lit(0)))


def _prose() -> Column:
    return (F.col("text") != "") & ~F.col("text").startswith("#")


def capabilities(files: DataFrame) -> DataFrame:
    """path, purpose: the prose under the heading Purpose, empty where there is none."""
    return _marked(files).groupBy("path").agg(_joined(F.col("purpose") & _prose(), "text", " ").alias("purpose"))


def requirements(files: DataFrame) -> DataFrame:
    """path, line, name, text (prose before the first scenario)."""
    under = _marked(files).filter("req_line > 0 and not purpose")
    return under.groupBy("path", F.col("req_line").alias("at")).agg(F.max("requirement").alias("name"), _joined(_prose() & (F.col("scen_line") == 0), "text", " ").alias("text")).select("path", F.col("at").alias("line"), "name", "text")


def scenarios(files: DataFrame) -> DataFrame:
    """path, req_line, line, name, given, when_clause, then_clause; steps of a kind are joined by ``|``.

    AND continues the THEN steps if there are any before it, else the WHEN, else the GIVEN steps.
    """
    inside = _marked(files).filter("scen_line > 0").withColumn("kind", F.upper(_part(STEP, 1))).withColumn("step", _part(STEP, 2))
    had = lambda kind: F.max(F.coalesce(F.col("kind") == kind, F.lit(False))).over(_so_far("path", "scen_line"))
    inside = inside.withColumn("slot", F.when(F.col("kind") != "AND", F.col("kind")).when(F.col("kind").isNotNull(), F.when(had("THEN"), "THEN").when(had("WHEN"), "WHEN").otherwise("GIVEN")))
    clause = lambda slot: _joined(F.col("slot") == slot, "step", " | ")
    found = inside.groupBy("path", "req_line", F.col("scen_line").alias("at")).agg(F.max("scenario").alias("name"), clause("GIVEN").alias("given"), clause("WHEN").alias("when_clause"), clause("THEN").alias("then_clause"))
    return found.withColumnRenamed("at", "line").select("path", "req_line", "line", "name", "given", "when_clause", "then_clause")


def deltas(files: DataFrame) -> DataFrame:
    """path, line, delta_type, rel, requirement, text: what a change does to requirements.

    Under RENAMED a TO line takes the FROM line before it; one without a FROM line is ignored.
    """
    kind = F.upper(_part(CHANGE))
    marked = _lines(files).withColumn("kind", kind)
    marked = marked.withColumn("delta_type", F.last("kind", ignorenulls=True).over(_so_far("path"))).withColumn("section", F.last(F.when(F.col("kind").isNotNull(), F.col("line")), ignorenulls=True).over(_so_far("path"))).filter("section is not null")
    renames = F.col("delta_type") == "RENAMED"
    name = lambda side: F.when(renames, _part(RENAME.format(side=side)))
    marked = marked.withColumn("old", name("FROM")).withColumn("new", name("TO")).withColumn("requirement", _part(REQUIREMENT))
    inside = Window.partitionBy("path", "section").orderBy("line")
    before = F.last(F.when(F.col("old").isNotNull() | F.col("new").isNotNull(), F.struct("old")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("from", before["old"]).withColumn("at", F.last(F.when(F.col("requirement").isNotNull(), F.col("line")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    body = _prose() & F.col("old").isNull() & F.col("new").isNull()
    whole = marked.filter("at is not null").groupBy("path", F.col("at").alias("_at"), "delta_type").agg(F.max("requirement").alias("requirement"), _joined(body, "text", " ").alias("text")).withColumnRenamed("_at", "line")
    renamed = marked.filter("new is not null and `from` is not null").select("path", "line", "delta_type", F.col("new").alias("requirement"), F.concat(F.lit("(renamed from: "), F.col("from"), F.lit(")")).alias("text"))
    rel = F.create_map(*(F.lit(x) for pair in RELATION.items() for x in pair))[F.col("delta_type")]
    return whole.unionByName(renamed).select("path", "line", "delta_type", rel.alias("rel"), "requirement", "text")
