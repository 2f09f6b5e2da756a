"""Deduplication of page records by identity keys.

A page is known by the URL keys and route keys of its final URL, its URL and its
aliases. `mode="routes"` groups by the route key of the final URL (exact where
records were not redirected and carry no aliases); `mode="components"` joins
records that share any key, directly or through others; `mode="sequential"`
takes records in order, each joining the first record it shares a key with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..workers import small_batches
from .scratch import settle, written

# Worth of sources and extractors.
SOURCE_RANK = {"llms": 6, "asset": 5, "sitemap": 4, "nav": 3, "crawl": 2, "seed": 1}
EXTRACTOR_RANK = {"markdown": 4, "text": 3, "html": 2, "fallback": 1}
_NONE = "array<string>"


def rank(column: str, ranks: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(0))


def record_score() -> Column:
    """Source, then extractor, then confidence against length, in one integer (hundredths)."""
    confidence = F.round(F.col("confidence") * 100).cast("long")
    words = F.least(T.word_count("markdown"), F.lit(2000)).cast("long")
    return rank("source", SOURCE_RANK) * 1_000_000 + rank("extractor", EXTRACTOR_RANK) * 100_000 + confidence * 100 + words


def identity_keys() -> Column:
    urls = F.array_compact(F.concat(F.array("final_url", "url"), F.coalesce("aliases", F.array().cast(_NONE))))
    return F.array_distinct(F.flatten(F.transform(urls, lambda u: F.array(U.url_key(u), U.route_key(u)))))


def components(keys: DataFrame, limit: int = 60) -> DataFrame:
    """`ord`, `part`: least ord among the records that keys (ord, key) connect; records that share no key are left out."""
    keys = settle(keys.distinct())
    # Most records are alone: only keys held twice connect any.
    keys = settle(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key"))
    state = settle(keys.select("ord").distinct().withColumn("part", F.col("ord")))
    for _ in range(limit):
        shared = keys.join(state, "ord").groupBy("key").agg(F.min("part").alias("low"))
        nearer = keys.join(shared, "key").groupBy("ord").agg(F.min("low").alias("low"))
        # Then jump: take the part that the reached record itself has reached.
        leap = state.select(F.col("ord").alias("low"), F.col("part").alias("further"))
        after = settle(
            state.join(nearer, "ord").join(leap, "low", "left").select("ord", F.least("part", "low", "further").alias("part"))
        )
        same = after.join(state.withColumnRenamed("part", "before"), "ord").where("part <> before").isEmpty()
        state = after
        if same:
            return state
    raise RuntimeError(f"components did not settle in {limit} rounds")


def dedupe(records: DataFrame, mode: str = "routes") -> DataFrame:
    """Survivors in the place (`ord`) of their group's first record, with merged aliases and links; failures pass."""
    good, bad = records.where("ok"), records.where("not ok")
    if mode == "sequential":
        return sequential(good, records.columns).unionByName(bad)
    if mode == "components":
        parts = components(good.select("ord", F.explode(identity_keys()).alias("key")))
        grouped = good.join(parts, "ord", "left").withColumn("part", F.coalesce("part", "ord").cast("string"))
    else:
        grouped = good.withColumn("part", U.route_key("final_url"))
    urls = F.array_compact(F.array("url", "final_url", "canonical_url"))
    known = F.concat(urls, F.coalesce("aliases", F.array().cast(_NONE)))
    place = F.struct(record_score().alias("score"), (-F.col("ord")).alias("early"))
    # Keys and scores are written once: the texts are read for them here and joined again at the end only.
    each = written(grouped.select("ord", "part", place.alias("place"), known.alias("known"), "links"))
    # Aggregates rather than a window: a group of any size folds before the shuffle.
    groups = written(
        each.groupBy("part").agg(F.max("place.score").alias("top"), F.min("ord").alias("first"), (-F.max("place")["early"]).alias("best"), F.count(F.lit(1)).alias("size"))
    )
    several = each.join(groups.where("size > 1").select("part"), "part")
    shared = several.select("part", F.explode("known").alias("u")).groupBy("part").agg(F.collect_set("u").alias("urls"))
    linked = several.select("part", F.explode("links").alias("u")).groupBy("part").agg(F.array_sort(F.collect_set("u")).alias("all_links"))
    extra = groups.select("part", "first", "size", F.col("best").alias("ord")).join(shared, "part", "left").join(linked, "part", "left").drop("part")
    kept = good.join(extra, "ord")
    merged = F.array_sort(F.array_except(F.col("urls"), urls))
    aliases = F.when(F.col("size") == 1, F.col("aliases")).otherwise(F.when(F.size(merged) > 0, merged))
    links = F.when(F.col("size") == 1, F.col("links")).otherwise(F.coalesce("all_links", F.array().cast(_NONE)))
    out = kept.withColumn("aliases", aliases).withColumn("links", links).withColumn("ord", F.col("first"))
    return out.select(*records.columns).unionByName(bad)


def sequential(good: DataFrame, columns: list[str]) -> DataFrame:
    """Records in order, each component of shared keys folded alone; records that share no key stay as they are.

    Keys, scores, URLs and links are written once and folded; texts are joined at the end.
    A component is folded in order, so by one task, which holds its survivors only.
    """
    small_batches(good.sparkSession)
    held = ["ord", "url", "final_url", "canonical_url", "aliases", "links"]
    each = written(good.select(*held, identity_keys().alias("keys"), record_score().alias("score")))
    parts = components(each.select("ord", F.explode("keys").alias("key")))
    ready = each.join(parts, "ord").repartition("part").sortWithinPartitions("part", "ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups = None, _Fold()
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from groups.survivors()
                    part, groups = row["part"], _Fold()
                groups.take(row)
        yield from groups.survivors()

    folded = written(ready.mapInArrow(fold, "ord long, place long, merged_aliases array<string>, merged_links array<string>"))
    alone = good.join(parts.select("ord"), "ord", "left_anti").select(*columns)
    merged = good.join(folded, "ord").withColumn("ord", F.col("place")).withColumn("aliases", F.col("merged_aliases")).withColumn("links", F.col("merged_links"))
    return alone.unionByName(merged.select(*columns))


_FOLDED = pa.schema([("ord", pa.int64()), ("place", pa.int64()), ("merged_aliases", pa.list_(pa.string())), ("merged_links", pa.list_(pa.string()))])


class _Fold:
    """Survivors of records taken in order. A step costs what the record brings, whatever was merged before it."""

    def __init__(self):
        self.kept: list[dict] = []
        self.holder: dict[str, int] = {}

    def take(self, row: dict) -> None:
        home = next((self.holder[k] for k in row["keys"] if k in self.holder), len(self.kept))
        own = {u for u in (row["url"], row["final_url"], row["canonical_url"]) if u}
        known = own.union(row["aliases"] or ())
        if home == len(self.kept):
            self.kept.append(row | {"place": row["ord"], "own": own, "known": known, "held": set(row["keys"]), "merged": False, "robbed": False})
        else:
            at = self.kept[home]
            if not at["merged"]:
                at |= {"merged": True, "links": set(at["links"])}
            at["known"] |= known
            at["links"].update(row["links"])
            at["held"].update(row["keys"])
            if row["score"] > at["score"]:
                at |= {"ord": row["ord"], "score": row["score"], "own": own}
        # All keys of the survivor lead to it again; others may have taken some.
        for k in self.kept[home]["held"] if self.kept[home]["robbed"] else row["keys"]:
            if (other := self.holder.get(k, home)) != home:
                self.kept[other]["robbed"] = True
            self.holder[k] = home
        self.kept[home]["robbed"] = False

    def survivors(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.kept), 1024):
            rows = [
                {
                    "ord": r["ord"],
                    "place": r["place"],
                    "merged_aliases": (sorted(r["known"] - r["own"]) or None) if r["merged"] else r["aliases"],
                    "merged_links": sorted(r["links"]) if r["merged"] else r["links"],
                }
                for r in self.kept[i : i + 1024]
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)
