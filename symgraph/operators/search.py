"""Ranking of files for a free-text query over a code graph: names, paths, bodies, centrality.

files: id, path; symbols: id, path, name, doc, start, end; edges: src_path, dst_path, one row an edge.
A file's body is its path, its symbols' names and the first ``BODY_TOKENS`` tokens of their docs.
Everything is added up by file with partial aggregation; no file's tokens are gathered in a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import spread, written


def query_words(spark, query: str) -> tuple[list[str], list[str]]:
    """The different tokens of a query and the identifiers that it mentions."""
    row = spark.range(1).select(F.array_distinct(text.tokens(F.lit(query))), text.query_identifiers(F.lit(query))).first()  # one row
    return row[0], row[1]


def capped_docs(symbols: DataFrame, most: int = text.BODY_TOKENS) -> DataFrame:
    """symbols with ``body``: the tokens of doc, as far as its file's first ``most`` tokens (by start and id) go."""
    found = symbols.withColumn("body", text.tokens(F.coalesce("doc", F.lit("")))).withColumn("size", F.size("body").cast("long"))
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("start"), "id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(most) - F.coalesce(F.sum("size").over(order), F.lit(0)))
    return found.withColumn("body", F.slice("body", F.lit(1), room.cast("int"))).drop("size")


def representative_key(exact: F.Column) -> F.Column:
    """Least for the symbol that stands for a file: a wanted name first, then start (null last), name, end (null last)."""
    last = F.lit(2_147_483_647)
    return F.struct((~exact).alias("other"), F.coalesce("start", last).alias("at"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("end", last).alias("to"), F.col("start").alias("src_start"), F.col("end").alias("src_end"))


def corpus(files: DataFrame, symbols: DataFrame, edges: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a search needs whatever the query, as two tables that are written once.

    Files: file (relative path), file_id, tokens (of the path), centrality (not scaled).  Symbols: file, name,
    start, end, tokens (of the name and of the part of doc that counts).
    """
    relative = (lambda c: text.relative_path(F.col(c), project)) if project else F.col
    degree = edges.filter("src_path <> dst_path").groupBy("dst_path").agg(F.count(F.lit(1)).alias("c")).groupBy(relative("dst_path").alias("file")).agg(F.sum(F.log1p("c")).alias("central"))
    own = files.filter("path is not null").select(relative("path").alias("file"), F.col("id").alias("file_id")).groupBy("file").agg(F.max("file_id").alias("file_id"))
    by_file = own.join(degree, "file", "left").select("file", "file_id", text.tokens(F.replace("file", F.lit("/"), F.lit(" "))).alias("tokens"), F.coalesce("central", F.lit(0.0)).alias("centrality"))
    inside = capped_docs(spread(symbols.filter("path is not null")).withColumn("file", relative("path")))
    named = F.when(F.col("name").isNotNull(), text.sub_tokens(F.col("name"))).otherwise(F.array().cast("array<string>"))
    return written(by_file, "search-files"), written(inside.select("file", "name", "start", "end", F.concat(named, "body").alias("tokens")), "search-symbols")


def rank(by_file: DataFrame, by_symbol: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best ``limit`` files of a :func:`corpus`: file, file_id, score, name, src_start, src_end (of the symbol that stands for the file).

    The name term is scaled over files with a hit only, so equal hits all count 0; files without any
    lexical signal are left out.  Symbols of files that the table of files lacks do not count.
    """
    wanted, names = query_words(by_file.sparkSession, query)
    n = len(wanted)
    counts = [f"tf{i}" for i in range(n)]
    exact = F.coalesce(F.lower("name").isin(names), F.lit(False)) if names else F.lit(False)
    rows = by_symbol.select("file", F.size("tokens").cast("long").alias("dl"), *text.word_counts(F.col("tokens"), wanted), exact.cast("long").alias("name_hits"), F.when(F.col("name").isNotNull(), representative_key(exact)).alias("r"))
    added = rows.groupBy("file").agg(*(F.sum(c).alias(f"s_{c}") for c in ("dl", "name_hits", *counts)), F.min("r").alias("r"))
    paths = by_file.select("file", "file_id", "centrality", F.size("tokens").cast("long").alias("p_dl"), *(c.alias(f"p_tf{i}") for i, c in enumerate(text.word_counts(F.col("tokens"), wanted))))
    both = lambda c: F.col(f"p_{c}") + F.coalesce(f"s_{c}", F.lit(0))
    stats = paths.join(added, "file", "left").select(
        "file", "file_id", both("dl").cast("double").alias("dl"), *(both(c).alias(c) for c in counts), F.coalesce("s_name_hits", F.lit(0)).cast("double").alias("name_hits"),
        sum((F.least(F.col(f"p_{c}"), F.lit(1)) for c in counts), F.lit(0)).cast("double").alias("path_hits"), "centrality", "r",
    )
    stats = written(stats, "search")  # narrow: the tokens are read once
    scored = stats.join(F.broadcast(stats.agg(*text.bm25_totals(n)))).select("file", "file_id", "name_hits", "path_hits", text.bm25_score(n).alias("body"), "centrality", "r")  # one row
    bounds = scored.agg(*(f(F.when(F.col(c) > 0, F.col(c)) if c == "name_hits" else F.col(c)).alias(f"{c}_{b}") for c in ("name_hits", "path_hits", "body", "centrality") for f, b in ((F.min, "low"), (F.max, "high"))))
    part = lambda c, where=None: text.scaled(c, f"{c}_low", f"{c}_high", where)
    w = text.WEIGHTS
    score = w[0] * part("name_hits", F.col("name_hits") > 0) + w[1] * part("path_hits") + w[2] * part("body") + w[3] * part("centrality") - w[4] * F.col("file").rlike(text.PENALISED).cast("double")
    kept = scored.join(F.broadcast(bounds)).filter("name_hits > 0 or path_hits > 0 or body > 0")  # one row
    best = kept.select("file", "file_id", F.bround(score, 4).alias("score"), "r.name", "r.src_start", "r.src_end")
    return best.orderBy(F.desc("score"), "file").limit(limit)


def hybrid_rank(files: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, project: str | None = None, limit: int = 10) -> DataFrame:
    """:func:`rank` over a :func:`corpus` made for this query alone."""
    return rank(*corpus(files, symbols, edges, project), query, limit)


def snippets(symbols: DataFrame, lines: DataFrame, max_lines: int = 4, width: int = 200) -> DataFrame:
    """symbols: id, path, start, end; lines: path, line (from 1), text -> id, snippet.

    The first ``max_lines`` lines of a symbol behind leading blank lines and decorators, each cut at
    ``width`` characters; symbols without such lines or with a start below 1 have no row.
    """
    upto = F.least(F.greatest(F.coalesce("end", "start"), F.col("start")), F.col("start") + max_lines + 5)
    # whole numbers instead of a range join: each symbol asks for at most max_lines + 6 lines
    asked = symbols.filter("start >= 1").select("id", "path", F.explode(F.sequence(F.col("start").cast("long"), upto.cast("long"))).alias("line"))
    found = asked.join(lines.select("path", F.col("line").cast("long").alias("line"), F.col("text").alias("line_text")), ["path", "line"])
    solid = ~(F.trim(F.col("line_text")) == "") & ~F.ltrim(F.col("line_text")).startswith("@")
    order = Window.partitionBy("id").orderBy("line")
    begun = found.withColumn("begun", F.max(solid.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("begun = 1")
    first = begun.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_lines)
    rows = F.sort_array(F.collect_list(F.struct("line", F.substring("line_text", 1, width).alias("t"))))
    return first.groupBy("id").agg(rows.alias("rows")).select("id", F.array_join(F.col("rows.t"), "\n").alias("snippet"))


RELATION = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def valid_relation(rel) -> str:
    """``rel`` if it is a relation's name, else ValueError."""
    if not isinstance(rel, str) or not RELATION.fullmatch(rel):
        raise ValueError(f"no relation name: {rel!r}")
    return rel


def whole_number(value, what: str = "id") -> int:
    """An int, or one written as digits; anything else, truth values too, is a ValueError."""
    if isinstance(value, str) and re.fullmatch(r"-*\d+", value):
        return int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{what} must be an integer: {value!r}")
    return value


def clamped(value, most: int, what: str = "limit") -> int:
    """A whole number between 1 and ``most``: 200 for limits, 10 for depths."""
    return min(max(whole_number(value, what), 1), most)
