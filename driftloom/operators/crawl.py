"""Link graph of an archive and scoped breadth-first search over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .extract import page_features
from .scratch import settle


def page_links(pages: DataFrame, kind: str = "anchors") -> DataFrame:
    """Edges (src, pos, dst) of the pages (url, html): all anchors, or `nav` for navigation only."""
    read = page_features(pages.select("url", "html"), "html")
    found = read.select(F.col("url").alias("src"), U.normalise_references(F.col(f"dom.{kind}"), F.coalesce("url", F.lit(None))).alias("links"))
    return found.select("src", F.posexplode("links").alias("pos", "dst"))


def regular_links(pages: DataFrame) -> DataFrame:
    """Edges (src, pos, dst) by expressions alone, for pages whose anchors are regular and absolute or root-relative."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    hrefs = F.regexp_extract_all(plain, F.lit(r'<a href="([^"]*)"'), F.lit(1))
    absolute = F.transform(hrefs, lambda h: F.when(h.startswith("/") & ~h.startswith("//"), F.concat(U.origin("url"), h)).otherwise(h))
    pages_only = F.array_compact(F.array_distinct(F.transform(absolute, U.normalise_url)))
    return pages.select(F.col("url").alias("src"), F.posexplode(pages_only).alias("pos", "dst"))


def crawl(seeds: DataFrame, edges: DataFrame, depth: int | None = None, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """`seed`, `url`, `level` reached from the rows (seed, scope) inside their scopes, level by level, until nothing new is reached or `depth`.

    Each level joins the frontier with the edges and drops what was visited;
    levels are kept as they are and only added to. `most` bounds the pages of a
    seed, nearest level first.
    """
    edges = settle(edges.select("src", "dst").distinct() if allowed is None else edges.select("src", "dst").distinct().join(allowed.select(F.col("url").alias("dst")), "dst", "left_semi"))
    frontier = visited = settle(seeds.select("seed", "scope", F.col("seed").alias("url"), F.lit(0).alias("level")).distinct())
    level = 0
    while depth is None or level < depth:
        level += 1
        reached = frontier.join(edges, frontier.url == edges.src).select("seed", "scope", F.col("dst").alias("url"))
        fresh = reached.where(U.in_scope("url", F.col("seed"), F.col("scope"))).distinct().join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        frontier = settle(fresh.select("seed", "scope", "url", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % 16 == 0:
            visited = settle(visited)
    out = visited.where("level > 0").select("seed", "url", "level")
    if most is None:
        return out
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("seed").orderBy("level", "url"))
    return out.withColumn("place", place).where(F.col("place") <= most).drop("place")
