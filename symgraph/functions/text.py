"""Identifiers and ranking: tokens, sub-tokens, BM25, hybrid score, path predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread, written

# The identifier and camel-case patterns, the BM25 constants, the weights of the hybrid score
# (name, path, body, centrality, penalty) and the penalised paths decide the scores, so they must be these.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
_CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"
K1, B = 1.5, 0.75
WEIGHTS = (2.0, 1.5, 1.5, 0.5, 1.0)
LEAST_IDENTIFIER, BODY_TOKENS = 4, 4000
PENALISED = r"(?i)(^|/)(tests?|testing|conftest|migrations?|legacy|vendor|vendored|third_party|__pycache__|examples?|docs?|benchmarks?)(/|$)|_test\.py$|(^|/)test_"


def identifiers(text) -> F.Column:
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))


def sub_tokens(identifier: F.Column) -> F.Column:
    """Lower-cased parts at ``_`` and camel case, and the whole in lower case."""
    parts = F.flatten(F.transform(F.split(identifier, "_"), lambda p: F.regexp_extract_all(p, F.lit(f"({_CAMEL})"), F.lit(1))))
    return F.concat(F.transform(parts, lambda p: F.lower(p)), F.array(F.lower(identifier)))


def tokens(text) -> F.Column:
    """All sub-tokens of all identifiers of a text."""

    def split(word: F.Column) -> F.Column:
        return F.when(plain(word), F.array(F.lower(word), F.lower(word))).otherwise(sub_tokens(word))

    return F.filter(F.flatten(F.transform(identifiers(text), split)), lambda t: t != "")


def plain(word: F.Column) -> F.Column:
    """Whether an identifier is its own only part: no ``_``, no capital behind its first letter."""
    tail = F.substring(word, 2, 1 << 30)
    return (F.lower(tail) == tail) & ~word.contains("_")


def token_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, token, c: how often each sub-token is in each text.

    The identifiers are rows, not arrays inside arrays, so nearly all of them (plain words, which count twice) pass
    through generated code; only the others are split.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    words = rows.select("id", F.explode(identifiers(F.coalesce("text", F.lit("")))).alias("word"))
    parts = F.when(plain(F.col("word")), F.array(F.lower("word"))).otherwise(sub_tokens(F.col("word")))
    found = words.select("id", F.when(plain(F.col("word")), 2).otherwise(1).alias("times"), F.explode(parts).alias("token"))
    return found.filter("token <> ''").groupBy("token", "id").agg(F.sum("times").alias("c"))


def bm25_texts(docs: DataFrame, query: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """:func:`bm25` of texts whose tokens are nowhere stored: id, score."""
    query = list(dict.fromkeys(query))
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    words = rows.select("id", F.explode_outer(identifiers(F.coalesce("text", F.lit("")))).alias("word")).withColumns({"plain": plain(F.col("word")), "lower": F.lower("word")})
    parts = F.filter(sub_tokens(F.col("word")), lambda t: t != "")
    same = lambda w: F.when(F.col("plain"), F.when(F.col("lower") == w, 2).otherwise(0)).otherwise(F.size(F.filter(parts, lambda t: t == F.lit(w))))
    length = F.when(F.col("word").isNull(), 0).when(F.col("plain"), 2).otherwise(F.size(parts))
    counted = words.groupBy("id").agg(F.sum(length).cast("double").alias("dl"), *(F.coalesce(F.sum(same(w)), F.lit(0)).cast("long").alias(f"tf{i}") for i, w in enumerate(query)))
    stats = written(counted, "bm25")
    return stats.join(F.broadcast(stats.agg(*bm25_totals(len(query))))).select("id", bm25_score(len(query)).alias("score"))  # one row is broadcast


def query_identifiers(text) -> F.Column:
    """Words of four letters or more in lower case: all inside backticks, elsewhere those that look like code."""
    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), identifiers))
    rest = F.filter(identifiers(text), lambda w: w.contains("_") | w.rlike("[a-z][A-Z]") | w.rlike("^[A-Z]"))
    return F.array_distinct(F.transform(F.filter(F.concat(quoted, rest), lambda w: F.length(w) >= LEAST_IDENTIFIER), lambda w: F.lower(w)))


def word_counts(found: F.Column, query: list[str]) -> list[F.Column]:
    """How often each word of ``query`` is in an array of tokens: tf0, tf1, ..."""
    wanted = F.filter(found, lambda t: t.isin(query))
    same = lambda w: lambda t: t == F.lit(w)
    return [F.size(F.filter(wanted, same(w))).cast("long").alias(f"tf{i}") for i, w in enumerate(query)]


def bm25_totals(n_words: int) -> list[F.Column]:
    """Number of documents, average length, and documents with each word, over rows of dl, tf0, tf1, ..."""
    return [F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(n_words))]


def bm25_score(n_words: int) -> F.Column:
    """The score of a row with dl, tf0, ... and the totals of all rows."""
    norm = K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    score = F.lit(0.0)
    for i in range(n_words):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
    return score


def bm25(docs: DataFrame, query: list[str], id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """BM25 of every document (0 without a hit): id, score.  Documents without tokens count; a repeated query word counts once.

    The texts are read once, into a narrow table of lengths and of counts of the query's words.
    """
    query = list(dict.fromkeys(query))
    found = F.col(tokens_col)
    stats = written(docs.select(F.col(id_col).alias("id"), F.size(found).cast("double").alias("dl"), *word_counts(found, query)), "bm25")
    return stats.join(F.broadcast(stats.agg(*bm25_totals(len(query))))).select("id", bm25_score(len(query)).alias("score"))  # one row is broadcast


def scaled(column: str, low: str, high: str, where: F.Column | None = None) -> F.Column:
    """Min-max scaling with known bounds; constant input gives 0; outside ``where`` 0."""
    value = F.when(F.col(high) - F.col(low) > 1e-12, (F.col(column) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)
    return value if where is None else F.when(where, value).otherwise(0.0)


def relative_path(path, project: str) -> F.Column:
    """What follows the first ``/project/``; the path itself without one."""
    return F.regexp_replace(path, f"^.*?/\\Q{project}\\E/", "")


def graph_key(name) -> F.Column:
    """``code:project:branch`` as a struct; other names are projects on ``_default``."""
    pattern = "^code:([^:]+):(.+)$"
    known = name.rlike(pattern)
    return F.struct(F.when(known, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("project"), F.when(known, F.regexp_extract(name, pattern, 2)).otherwise("_default").alias("branch"))


def graph_name(project, branch) -> F.Column:
    """The reverse of :func:`graph_key`; a missing or empty branch is ``_default``."""
    return F.concat(F.lit("code:"), project, F.lit(":"), F.coalesce(F.nullif(F.trim(branch), F.lit("")), F.lit("_default")))


def helper_key(project, branch=None, kind: str = "info") -> F.Column:
    """The key of a graph's helper of some kind; without a branch the old form, an empty branch is ``_default``."""
    at = F.lit("") if branch is None else F.concat(F.lit(":"), F.coalesce(F.nullif(branch, F.lit("")), F.lit("_default")))
    return F.concat(F.lit("{"), project, F.lit("}"), at, F.lit(f"_{kind}"))


def info_key(project, branch=None) -> F.Column:
    return helper_key(project, branch, "info")


def git_key(project, branch=None) -> F.Column:
    return helper_key(project, branch, "git")


def is_internal(name) -> F.Column:
    """Names of helper graphs."""
    return name.rlike("_(git|schema|tmp)$")


def https_url(url) -> F.Column:
    """``git@host:owner/repo.git`` as an https address without ``.git``; other addresses lose that only."""
    return F.regexp_replace(F.regexp_replace(url, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/"), r"\.git/?$", "")


def project_of_url(url) -> F.Column:
    """The last part of an address, without ``.git``."""
    return F.regexp_extract(https_url(F.regexp_replace(url, "/+$", "")), "([^/:]+)$", 1)


def slug(name) -> F.Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def token_estimate(text) -> F.Column:
    """A quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def reduction(found: F.Column, plain_: F.Column) -> F.Column:
    """By how many percent ``found`` tokens are fewer than ``plain_`` ones, to one digit; 0 where there are none."""
    return F.when(plain_ > 0, F.bround((plain_ - found) / plain_ * 100, 1)).otherwise(0.0)
