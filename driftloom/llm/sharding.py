"""Sharding by balanced label propagation, in DataFrame expressions only.

Documents are nodes; a hub links all documents that share it (here: equal
texts). Labels are shards. In each round a hub's documents are drawn to the
shard where most of them are, among those with room for the others; moves are
accepted up to each shard's quota of documents, decided by a cumulative count
over 4,096 hash bins for each shard. Hubs that found no shard with room are tried
again with room for SLACK more than the quota, so that groups can gather even
where all documents are linked, then cut into quarters of themselves. What lies
beyond the quota at the end, whole hubs as far as possible, and documents
without links fill what is left, hub by hub, so that counts differ by one at
most. A hub larger than a shard is cut into halves of a shard first.

Every choice depends on a hash of doc_id, text and copy number (of rows equal in
both), never on the place of a row in the table, so the result is the same for
any layout. Only tables of 16 rows, or 16 by 4,096, are gathered; ranks are
taken inside bounded cells, and a hub too large for one is ranked in pieces.

Defined results: null text is an empty text of size 1; null doc_ids are placed
like others; repeated rows are told apart by their copy number; texts are read
whole; an empty table gives an empty result; other columns, of any name, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime as rt

SHARDS = 16
ROUNDS = 8
BINS = 4096
SLACK = 0.25


def quotas(n: int, shards: int = SHARDS) -> list[int]:
    return [n // shards + (i < n % shards) for i in range(shards)]


def _longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    return [got.get(i, 0) for i in range(shards)]


def propagate(links: DataFrame, limit: list[int], rounds: int = ROUNDS) -> DataFrame:
    """`node`, `key`, `hub`, `shard` for the rows (node, key, hub) of `links`, each node in one hub.

    `key` is a hash of the node's content. Starts from the column `shard`, or
    else from `key`, and ends when no hub has a move left within `limit`, or
    after `rounds`.
    """
    shards = len(limit)
    if "shard" not in links.columns:
        links = links.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("label")), F.lit(shards)).cast("int"))
    state = rt.materialise(links, "labels")
    whole = W.partitionBy("hub")
    for _ in range(rounds):
        room = [q - x for q, x in zip(limit, _loads(state, shards), strict=True)]
        held = state.groupBy("hub", "shard").count().withColumn("size", F.sum("count").over(whole))
        spread = F.count(F.lit(1)).over(whole)
        free = F.get(_longs(room), F.col("shard"))
        pull = F.struct((free >= F.col("size") - F.col("count")).alias("fits"), "count", F.xxhash64("hub", "shard").alias("tie"), "shard")
        best = F.max(pull).over(whole)
        drawn = held.withColumn("best", best).withColumn("spread", spread)
        wanted = drawn.where((F.col("spread") > 1) & F.col("best.fits")).where("shard = best.shard")
        wanted = wanted.select("hub", F.col("best.shard").alias("to"), (F.col("size") - F.col("count")).alias("come"))
        wanted = rt.materialise(wanted.withColumn("bin", F.pmod(F.xxhash64("hub"), F.lit(BINS)).cast("int")), "wishes")
        bins = wanted.groupBy("to", "bin").agg(F.sum("come").alias("come"))
        upto = F.sum("come").over(W.partitionBy("to").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        edge = bins.withColumn("upto", upto).where(F.col("upto") <= F.get(_longs(room), F.col("to"))).groupBy("to").agg(F.max("bin").alias("edge"))
        edges = {r["to"]: r["edge"] for r in edge.collect()}
        if not edges:
            rt.discard(wanted)
            break
        accepted = wanted.where(F.col("bin") <= F.get(_longs([edges.get(i, -1) for i in range(shards)]), F.col("to"))).select("hub", "to")
        moved = state.join(accepted, "hub", "left").select("node", "key", "hub", F.coalesce("to", "shard").alias("shard"))
        former, state = state, rt.materialise(moved, "labels")
        rt.discard(former)
        rt.discard(wanted)
    return state


def _part(hub: Column, key: Column, parts: Column) -> Column:
    return F.concat(hub, F.encode(F.concat(F.lit("/"), F.pmod(F.xxhash64(key, F.lit("part")), parts).cast("string")), "UTF-8"))


def _spread(state: DataFrame, limit: list[int]) -> DataFrame:
    """The state after further propagation within `limit` while hubs are spread: whole ones, then cut in four."""
    for parts in (1, 4):
        cut = state.groupBy("hub").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).where("low < high").select("hub", F.lit(parts).alias("parts"))
        cut = rt.materialise(cut, "cut")
        if cut.isEmpty():
            return state
        if parts > 1:
            parted = state.join(cut, "hub", "left")
            hub = F.when(F.col("parts").isNull(), F.col("hub")).otherwise(_part(F.col("hub"), F.col("key"), F.col("parts")))
            state = parted.select("node", "key", hub.alias("hub"), "shard")
        state = propagate(state, limit)
    return state


def _pieces(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """`rows` with `piece`: 0, and in hubs whose `copies` in `sizes` exceed `most` one of the pieces of about that size, by key."""
    heavy = rt.materialise(sizes.where(F.col("copies") > most).select("hub", F.ceil(F.col("copies") / most).alias("pieces")), "heavy")
    if heavy.isEmpty():
        return rows.withColumn("piece", F.lit(0))
    return rows.join(heavy, "hub", "left").withColumn("piece", F.coalesce(F.pmod("key", "pieces"), F.lit(0))).drop("pieces")


def _fitted(state: DataFrame, quota: list[int], n: int, most: int = rt.ROWS_PER_TASK) -> DataFrame:
    """Drop what a shard holds beyond its quota, whole hubs as far as possible."""
    if all(x <= q for x, q in zip(_loads(state, len(quota)), quota, strict=True)):
        return state
    order = [F.col("hub"), F.col("key")]
    sizes = state.groupBy("hub").agg(F.count(F.lit(1)).alias("copies"))
    ranks = rt.ranked(_pieces(state, sizes, most), ["shard"], order, n, "__dl_rank", deal=[F.col("hub")], piece=F.col("piece"))
    return ranks.where(F.col("__dl_rank") < F.get(_longs(quota), F.col("shard"))).drop("__dl_rank", "piece")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, `hub` (SHA-256 of the text), a row id `node` and a `key` of doc_id, text and copy number; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("hub"))
    rows = rt.materialise(rt.with_row_id(rows, "node"), "documents")
    twice = rt.materialise(rows.groupBy("hub", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twice")
    if twice.isEmpty():
        return rows.withColumn("key", F.xxhash64("hub", "doc_id", F.lit(0).cast("long")))
    # Copies are numbered in cells, so no group of them is ranked in one task.
    pair = F.xxhash64("hub", "doc_id").alias("pair")
    again = rows.select("node", pair).join(twice.select(pair).distinct(), "pair", "left_semi")
    again = rt.ranked(again, ["pair"], [F.col("node")], rows.count(), "copy").select("node", "copy")
    copy = F.coalesce("copy", F.lit(0).cast("long"))
    return rt.materialise(rows.join(again, "node", "left").withColumn("key", F.xxhash64("hub", "doc_id", copy)).drop("copy"), "keyed")


def shard(docs: DataFrame, shards: int = SHARDS, most: int = rt.ROWS_PER_TASK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; hubs above `most` rows are ranked in pieces."""
    rows = keyed(docs)
    n = rows.count()
    quota = quotas(n, shards)
    share = max(1, n // shards)
    # Written first, so that the join below can split a hot group.
    groups = rt.materialise(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    with rt.passing():
        parts = F.when(F.col("copies") > share, F.ceil(F.col("copies") * 2 / F.lit(share))).otherwise(1)
        linked = rows.join(groups, "hub").select("node", "key", _part(F.col("hub"), F.col("key"), parts).alias("hub"))
        limit = [q + int(SLACK * q) for q in quota]
        state = _spread(propagate(linked, quota), limit)
        placed = rt.materialise(_fitted(state, quota, n, most).select("node", "shard"), "placed")
    left = [q - x for q, x in zip(quota, _loads(placed, shards), strict=True)]
    ends = [sum(left[: i + 1]) for i in range(shards)]
    rest = rows.join(placed, "node", "left_anti").select("node", "hub", "key")
    rest = rt.ranked(_pieces(rest, groups, most), [], [F.col("hub"), F.col("key")], n, "__dl_rank", deal=[F.col("hub")], piece=F.col("piece"))
    rest = rest.select("node", F.size(F.filter(_longs(ends), lambda x: x <= F.col("__dl_rank"))).alias("shard"))
    every = rows.drop("hub").join(placed.unionByName(rest), "node")
    return rt.ranked(every, ["shard"], [F.col("key"), F.col("doc_id")], n, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
