"""Catalogue of stored graphs: a versioned table of names, each change one atomic commit, and the migration of old names.

A graph is a folder that is never written again; a name is a row that points to one. So clones and renames copy no
data, a graph is replaced by one new pointer, and who reads an older version goes on reading its folders.

``root/tables/<id>`` is the table of a version, ``root/log/<number>`` the small file that names it. That file is moved
to its place by a rename that refuses an existing target; of two writers one has to start again from the newer
version. The file system's rename of a file must be atomic (HDFS, local disks).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import git_key, graph_key, graph_name, info_key, is_internal
from ..shared import remove

#: ``kind`` is ``graph`` or ``info``; ``target`` is null, or where a staged migration will move the row (empty: it goes).
SCHEMA = "name string, kind string, folder string, target string"


class Conflict(Exception):
    """Another writer has committed the version that was to be written."""


def plan(rows: DataFrame) -> DataFrame:
    """rows: name, kind -> name, kind, target of what an old name makes move.

    A graph without ``code:project:branch`` goes to branch ``_default``, together with its ``{project}_info`` and its
    ``{project}_git``. Where the new graph exists already, an earlier run was stopped before it dropped the old one:
    the target is empty and the old one goes. Information under a new key that is taken stays where it is.
    """
    names = rows.select("name", "kind").distinct()
    parsed = graph_key(F.col("name"))
    old = names.filter((F.col("kind") == "graph") & (parsed["project"] == F.col("name")) & ~is_internal(F.col("name"))).select(F.col("name").alias("project"))
    main, default = F.col("project"), F.lit("")
    moves = F.array(*(F.struct(name.alias("name"), F.lit(kind).alias("kind"), target.alias("target")) for name, kind, target in (
        (main, "graph", graph_name(main, default)),
        (info_key(main), "info", info_key(main, default)),
        (git_key(main), "graph", git_key(main, default)),
    )))
    wanted = old.select("project", F.explode(moves).alias("m")).select("project", "m.*").join(names, ["name", "kind"], "left_semi")
    taken = names.select(F.col("name").alias("target"), "kind", F.lit(True).alias("taken"))
    found = wanted.join(taken, ["target", "kind"], "left")
    stays = F.col("taken").isNotNull() & (F.col("kind") == "info")
    return found.filter(~stays).select("name", "kind", F.when(F.col("taken"), "").otherwise(F.col("target")).alias("target"), "project")


def summary(moves: DataFrame) -> DataFrame:
    """What a plan does: kind (graph, info, git), renamed, dropped."""
    kind = F.when(F.col("name") == git_key(F.col("project")), "git").otherwise(F.col("kind"))
    return moves.groupBy(kind.alias("kind")).agg(F.count_if(F.col("target") != "").alias("renamed"), F.count_if(F.col("target") == "").alias("dropped"))


class Catalogue:
    """The graphs below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest version, 0 for an empty catalogue."""
        folder = self._path("log")
        files = folder.getFileSystem(self._conf)
        numbers = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def _table(self, version: int) -> str:
        path = self._path(f"log/{version:020d}")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return f"{self.root}/tables/{self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def rows(self, version: int | None = None) -> DataFrame:
        """name, kind, folder, target at a version (the newest without one)."""
        version = self.version() if version is None else version
        return self.spark.read.schema(SCHEMA).parquet(self._table(version)) if version else self.spark.createDataFrame([], SCHEMA)

    def _claim(self, version: int, table: str) -> None:
        staged, place = self._path(f"staged-{table}"), self._path(f"log/{version:020d}")
        files = staged.getFileSystem(self._conf)
        files.mkdirs(place.getParent())
        stream = files.create(staged, True)
        try:
            stream.write(bytearray(table, "utf-8"))
        finally:
            stream.close()
        mode = getattr(self._hadoop, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        try:
            self._hadoop.FileContext.getFileContext(place.toUri(), self._conf).rename(staged, place, modes)
        except Exception as error:
            files.delete(staged, False)
            if files.exists(place):
                raise Conflict(f"version {version} exists") from error
            raise

    def commit(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Carry out ``change`` on the newest table as one step; the number of the version that it made.

        It may be called again when another writer was faster. Two rows of one name and kind are an error, and
        nothing is changed then.
        """
        for left in reversed(range(tries)):
            before, table = self.version(), uuid.uuid4().hex
            path = f"{self.root}/tables/{table}"
            try:
                change(self.rows(before)).select("name", "kind", "folder", "target").write.parquet(path)
                twice = self.spark.read.schema(SCHEMA).parquet(path).groupBy("name", "kind").count().filter("count > 1").first()
                if twice:
                    raise ValueError(f"there is a {twice['kind']} {twice['name']}")
                self._claim(before + 1, table)
                return before + 1
            except Conflict:
                remove(self.spark, path)
                if not left:
                    raise
            except Exception:
                remove(self.spark, path)
                raise
        raise ValueError("tries must be positive")

    def _row(self, name: str, kind: str, folder: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(folder).alias("folder"), F.lit(None).cast("string").alias("target"))

    def folder(self, name: str, kind: str = "graph", version: int | None = None) -> str:
        found = self.rows(version).filter((F.col("name") == name) & (F.col("kind") == kind)).first()
        if found is None:
            raise KeyError(name)
        return found["folder"]

    def exists(self, name: str) -> bool:
        return not self.rows().filter((F.col("name") == name) & (F.col("kind") == "graph")).isEmpty()

    def put(self, name: str, nodes: DataFrame, edges: DataFrame, replace: bool = False) -> int:
        """Write a graph, then point ``name`` to it; an error if the name is taken and not to be replaced."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        try:
            nodes.write.parquet(f"{folder}/nodes")
            edges.write.parquet(f"{folder}/edges")
            mine = (F.col("name") == name) & (F.col("kind") == "graph")
            return self.commit(lambda rows: (rows.filter(~mine) if replace else rows).unionByName(self._row(name, "graph", folder)))
        except Exception:
            remove(self.spark, folder)
            raise

    def load(self, name: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """nodes, edges; KeyError without such a graph."""
        folder = self.folder(name, version=version)
        return self.spark.read.parquet(f"{folder}/nodes"), self.spark.read.parquet(f"{folder}/edges")

    def clone(self, name: str, to: str) -> int:
        """A second name for the same folder; an error if it is taken."""
        folder = self.folder(name)
        return self.commit(lambda rows: rows.unionByName(self._row(to, "graph", folder)))

    def rename(self, name: str, to: str) -> int:
        self.folder(name)
        mine = (F.col("name") == name) & (F.col("kind") == "graph")
        return self.commit(lambda rows: rows.withColumn("name", F.when(mine, F.lit(to)).otherwise(F.col("name"))))

    def delete(self, name: str) -> int:
        self.folder(name)
        return self.commit(lambda rows: rows.filter(~((F.col("name") == name) & (F.col("kind") == "graph"))))

    def stage(self) -> int:
        """Write the plan of a migration into the table; every row is still read under its old name."""
        return self.commit(lambda rows: rows.drop("target").join(plan(rows).select("name", "kind", "target"), ["name", "kind"], "left"))

    def move(self, part: int, parts: int) -> int:
        """Carry out what is staged for a part of the projects; a project's rows are in one part and move together."""
        project = F.regexp_replace("name", r"^\{(.*)\}_(info|git)$", "$1")
        mine = F.col("target").isNotNull() & (F.pmod(F.xxhash64(project), F.lit(parts)) == part)
        def moved(rows: DataFrame) -> DataFrame:
            now = rows.select("*", mine.alias("mine")).filter("not mine or target <> ''")
            return now.select(F.when(F.col("mine"), F.col("target")).otherwise(F.col("name")).alias("name"), "kind", "folder", F.when(~F.col("mine"), F.col("target")).alias("target"))
        return self.commit(moved)

    def migrate(self, parts: int = 1, dry_run: bool = False) -> DataFrame:
        """Move all old names, after finishing what a stopped run had staged; what there was to do, as in :func:`summary`.

        A dry run writes nothing. A second run finds nothing to do.
        """
        rows = self.rows()
        left = rows.filter("target is not null")
        resumed = not left.isEmpty()
        project = F.regexp_replace("name", r"^\{(.*)\}_(info|git)$", "$1").alias("project")
        todo = summary(left.select("name", "kind", "target", project) if resumed else plan(rows))
        if dry_run:
            return todo
        if not resumed:
            if plan(rows).isEmpty():
                return todo
            self.stage()
        for part in range(parts):
            self.move(part, parts)
        return todo

    def vacuum(self, keep: int = 1) -> int:
        """Delete the tables of all but the newest ``keep`` versions and the folders that only those name; how many folders.

        For when nobody reads older versions. Folders of information are not touched.
        """
        last = self.version()
        if keep < 1:
            raise ValueError("at least one version stays")
        folder = self._path("log")
        files = folder.getFileSystem(self._conf)
        gone = [v for v in range(1, last - keep + 1) if files.exists(self._path(f"log/{v:020d}"))]
        if not gone:
            return 0
        read = lambda versions: self.spark.read.schema(SCHEMA).parquet(*map(self._table, versions)).filter("kind = 'graph'").select("folder").distinct()
        deleted = 0
        for row in read(gone).join(read(range(last - keep + 1, last + 1)), "folder", "left_anti").toLocalIterator():
            if row["folder"].startswith(f"{self.root}/data/"):
                remove(self.spark, row["folder"])
                deleted += 1
        for v in gone:
            remove(self.spark, self._table(v))
            files.delete(self._path(f"log/{v:020d}"), False)
        return deleted
