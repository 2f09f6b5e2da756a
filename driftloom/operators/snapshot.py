"""Content addresses: hashes of parts, leaves and the Merkle root of a set of files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

#: Levels that one pass folds: blocks of 2^LEVELS nodes.
LEVELS = 10


def hash_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def hash_parts(*parts: Column) -> Column:
    """Hash of parts, each ended by a zero byte."""
    return hash_text(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]))


def hash_parts_here(*parts: str) -> str:
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def leaves(files: DataFrame) -> DataFrame:
    """The files (path, body) with `leaf` and `bytes`."""
    return files.withColumn("leaf", hash_parts(F.lit("leaf"), F.col("path"), hash_text(F.col("body")))).withColumn("bytes", byte_length(F.col("body")))


def _level(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: hash_parts(F.lit("node"), F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i))))


def _positions(level: DataFrame) -> DataFrame:
    """Place of each leaf in the sorted order, by hash prefixes: hashes spread evenly, so cells stay small."""
    cell = level.withColumn("cell", F.substring("node", 1, 4))
    counts = cell.groupBy("cell").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cell", before.alias("before"))
    local = F.row_number().over(W.partitionBy("cell").orderBy("node")) - 1
    return cell.withColumn("local", local).join(counts, "cell").select((F.col("before") + F.col("local")).alias("at"), "node")


def fold_here(nodes: list[str]) -> str:
    while len(nodes) > 1:
        nodes = [hash_parts_here("node", nodes[i], nodes[min(i + 1, len(nodes) - 1)]) for i in range(0, len(nodes), 2)]
    return hash_parts_here("root", *nodes)


def root(files: DataFrame) -> tuple[str, int, int]:
    """Root hash, number of files and bytes. Blocks of 1,024 nodes are folded in tasks, the last 1,024 here."""
    marked = settle(leaves(files).select("leaf", "bytes"))
    n, total = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    level, size, width = _positions(marked.select(F.col("leaf").alias("node"))), n, 1 << LEVELS
    while size > width:
        blocks = level.groupBy((F.shiftright("at", LEVELS)).alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("nodes"))
        folded = F.col("nodes")
        for k in range(LEVELS):
            blocks = blocks.withColumn("nodes", _level(folded))
        level = settle(blocks.select("at", F.get("nodes", 0).alias("node")))
        size = -(-size // width)
    return fold_here([r.node for r in level.orderBy("at").collect()]), n, total
