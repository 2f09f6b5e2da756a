"""Scopes: how wide a part of a site a capture takes, and which foreign corpus it follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from .paths import shared_length

#: Fixed value: endings of corpus files.
CORPUS_FILES = r"(?i)\.(?:mdx?|txt|ya?ml|json)$"


def parent_scopes(scope: str) -> list[str]:
    """Nearest first, the whole site last."""
    parts = [p for p in scope.split("/") if p]
    return [f"/{'/'.join(parts[:i])}/" for i in range(len(parts) - 1, 0, -1)] + ["/"]


def scope_counts(links: DataFrame, seed: str, scopes: list[str]) -> DataFrame:
    """`place`, `scope`, `n`: links (url) inside each scope, counted in one pass."""
    inside = [F.count_if(U.in_scope("url", F.lit(seed), F.lit(s))).alias(f"n{i}") for i, s in enumerate(scopes)]
    one = links.agg(*inside)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("scope"), F.col(f"n{i}").alias("n")) for i, s in enumerate(scopes)])).alias("x")).select("x.*")


def widest(counted: list[tuple[str, int]]) -> str:
    """The first scope, or a parent with over two links more than the best so far; the site only if that has under three."""
    best, most = counted[0]
    for scope, n in counted[1:]:
        if not (scope == "/" and most >= 3) and n > most + 2:
            best, most = scope, n
    return best


def related_hosts(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def common_scope(urls: DataFrame, group: str) -> DataFrame:
    """`group`, `scope`: the directory that all of a group's URLs share."""
    ends = urls.withColumn("parts", U.segments(U.path("url"))).groupBy(group).agg(F.min("parts").alias("low"), F.max("parts").alias("high"))
    shared = F.slice("low", 1, shared_length(F.col("low"), F.col("high")))
    return ends.select(group, F.when(F.size(shared) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(shared, "/"), F.lit("/"))).alias("scope"))


def corpus_targets(links: DataFrame) -> DataFrame:
    """For each `seed` of the rows (seed, ord, url), the foreign origin it points at as a corpus, and its scope.

    That is the origin with most links (first on ties), if it has an index at
    its root, or five links and either mostly corpus files or a related host.
    """
    foreign = links.withColumn("origin", U.origin("url")).where(F.col("origin") != U.origin("seed"))
    counted = foreign.groupBy("seed", "origin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(U.path("url").rlike(CORPUS_FILES)).alias("files"),
        F.max(U.path("url") == "/llms.txt").alias("indexed"),
        F.min("ord").alias("first"),
    )
    first = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("n"), "first"))
    best = counted.withColumn("place", first).where("place = 1")
    heavy = F.col("files") >= 0.8 * F.col("n")
    fits = F.col("indexed") | ((F.col("n") >= 5) & (heavy | related_hosts(U.hostname("seed"), U.hostname("origin"))))
    keyed = foreign.join(best.where(fits).select("seed", "origin", heavy.alias("heavy"), "indexed"), ["seed", "origin"]).withColumn("pair", F.struct("seed", "origin"))
    scopes = common_scope(keyed, "pair").select("pair.*", "scope")
    found = scopes.join(best.select("seed", "origin", heavy.alias("heavy"), "indexed"), ["seed", "origin"])
    return found.where((F.col("scope") != "/") | F.col("heavy") | F.col("indexed")).select("seed", "origin", "scope")
