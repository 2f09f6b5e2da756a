"""Output paths, the map from URLs to them, and links between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .extract import resolve_bare
from .scratch import written

#: Fixed value: endings that a page's path loses.
PATH_FILES = r"(?i)\.(?:html?|mdx?|ya?ml|json|txt)$"


def output_candidates(records: DataFrame, most: int | None) -> DataFrame:
    """Pages that get a file: all, or the first `most` in order."""
    good = records.where("ok")
    return good if most is None else good.orderBy("ord").limit(most)


def slug(segment: Column) -> Column:
    clean = F.regexp_replace(F.lower(U.decoded(segment)), PATH_FILES, "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(clean.rlike(r"^\.*$"), "page").otherwise(clean)


def output_segments(url: Column) -> Column:
    here = U.path(url)
    parts = F.transform(U.segments(here), slug)
    index = F.when(here.endswith("/") | (F.size(parts) == 0), F.array(F.lit("index"))).otherwise(F.array().cast("array<string>"))
    return F.concat(parts, index)


def shared_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(F.least(first - 1, F.size(a), F.size(b))).cast("int")


def common_prefix(records: DataFrame) -> DataFrame:
    """One row: the leading segments that all pages share.

    The common prefix of many arrays is that of the least and the greatest.
    """
    ends = records.agg(F.min("segments").alias("low"), F.max("segments").alias("high"), F.count(F.lit(1)).alias("n"))
    return ends.select(F.when(F.col("n") < 2, 0).otherwise(F.coalesce(shared_length(F.col("low"), F.col("high")), F.lit(0))).alias("cut"))


#: Digits of the URL's hash that equal paths get; where these are equal too, all digits.
TAIL, WHOLE = 8, 64


def assign_paths(records: DataFrame, most: int | None = None) -> DataFrame:
    """The records with `output_path`; equal paths all get a part of their URL's hash.

    Two pages of one URL that still clash share a path; different URLs never do.
    """
    chosen = written(output_candidates(records, most).select("ord", "url", output_segments(F.col("final_url")).alias("segments")))
    rest = F.slice(F.col("segments"), F.col("cut") + 1, F.size("segments"))
    base = F.when(F.size(rest) == 0, "index").otherwise(F.array_join(rest, "/"))
    based = chosen.crossJoin(F.broadcast(common_prefix(chosen))).select("ord", F.sha2(F.col("url").cast("binary"), 256).alias("hash"), base.alias("base"))
    twice = based.groupBy("base").count().where("count > 1").select("base", F.lit(True).alias("twice"))
    named = based.join(twice, "base", "left")
    tail = F.substring("hash", 1, TAIL)
    # Tails that two URLs of one path share are lengthened; among few pages of a path there are none.
    again = named.where("twice").groupBy("base", tail.alias("tail")).agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    again = again.where("low <> high").select("base", "tail", F.lit(True).alias("again"))
    named = named.withColumn("tail", tail).join(again, ["base", "tail"], "left")
    ending = F.when(F.col("again"), F.concat(F.lit("-"), F.substring("hash", 1, WHOLE))).when(F.col("twice"), F.concat(F.lit("-"), "tail")).otherwise("")
    paths = named.select("ord", F.concat("base", ending, F.lit(".md")).alias("output_path"))
    return records.drop("output_path").join(paths, "ord", "left").select(*records.columns)


def path_map(records: DataFrame) -> DataFrame:
    """`target`, `output_path`: where each URL's page is; the last record wins."""
    urls = F.array_compact(F.concat(F.array("url", "final_url", "canonical_url"), F.coalesce("aliases", F.array().cast("array<string>"))))
    named = records.where(T.has_output()).select("ord", "output_path", F.posexplode(urls).alias("pos", "u"))
    return named.groupBy(U.without_query("u").alias("target")).agg(F.max_by("output_path", F.struct("ord", "pos")).alias("output_path"))


def relative_path(source: Column, target: Column) -> Column:
    """The way from one file to another, starting with a dot."""
    here = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1)
    there = F.split(target, "/")
    common = F.least(shared_length(here, there), F.size(there) - 1)
    up = F.array_repeat(F.lit(".."), F.size(here) - common)
    way = F.array_join(F.concat(up, F.slice(there, common + 1, F.size(there))), "/")
    return F.when(way.startswith("."), way).otherwise(F.concat(F.lit("./"), way))


def rewrite_links(records: DataFrame) -> DataFrame:
    """Links to captured pages become relative paths; the body is trimmed and hashed anew."""
    links = records.where(T.has_output()).select("ord", "final_url", F.col("output_path").alias("source"), F.posexplode(T.link_hrefs("markdown")).alias("pos", "href"))
    resolved = links.withColumn("target", resolve_bare("href", "final_url")).where("target is not null")
    # Written first, so that the join can split a target that every page links to.
    hits = resolved.join(written(path_map(records)), "target").select("ord", F.struct("pos", relative_path(F.col("source"), F.col("output_path")).alias("way")).alias("hit"))
    ways = hits.groupBy("ord").agg(F.map_from_entries(F.collect_list("hit")).alias("ways"))

    def local(link: Column, index: Column) -> Column:
        way = F.try_element_at(F.col("ways"), index)
        return F.when(way.isNotNull(), F.concat(F.lit("["), link["text"], F.lit("]("), way, link["suffix"], F.lit(")")))

    body = F.when(F.col("ways").isNull(), F.col("markdown")).otherwise(T.replace_links("markdown", local))
    out = records.join(ways, "ord", "left").withColumn("markdown", F.when(F.col("ok"), T.strip(body)).otherwise(F.col("markdown")))
    return out.withColumn("content_hash", F.when(F.col("ok"), F.sha2(F.col("markdown").cast("binary"), 256)).otherwise(F.col("content_hash"))).select(*records.columns)


def first_of_url(discovered: DataFrame) -> DataFrame:
    """The first row, by `ord`, of each URL."""
    return discovered.groupBy("url").agg(F.min_by(F.struct(*discovered.columns), "ord").alias("row")).select("row.*")
