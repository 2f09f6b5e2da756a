"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of the segments' bit counts. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so links within four
bits lie within Manhattan distance four. The segments form three blocks of 11,
11 and 10; each of the three pairs of blocks leaves one block out, so their
distances add up to eight at most and one pair of blocks lies within two. On
that pair, both fingerprints reach a common grid point by moving one coordinate
by at most one step: each fingerprint enters the grid cells of its three
radius-1 balls (about 100) and is compared only with the fingerprints of its
cells, by exact Hamming distance. No link is missed and there is no cap; copies
of a fingerprint enter once.

Inside a cell a frontier search grows trees: each fingerprint is compared with
those not reached yet, so a cell of near copies costs about as many steps as it
has members and yields a spanning forest, not all pairs. Components of the
forests' edges are the components of all links. A cell above BLOCK members is cut
into blocks by a hash and each pair of blocks searched in a task of its own, so
no cell is held whole.

Defined results: null text counts as empty; texts without words share the
fingerprint zero and are linked like others; texts are read whole, in slices of
the Arrow batches, whatever their length; repeated rows share a fingerprint and a
component; null doc_ids never become a component's id unless it has no other;
an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as rt
from .graph import components, headed

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Bits of the three blocks of segments: for each pair of blocks, the block left out.
BLOCKS = ((0, 22), (22, 44), (44, 64))
#: Longest run of a cell that is compared pair by pair in one vector step.
SHORT = 8
#: Members of a cell that is searched in one piece.
BLOCK = 1 << 16


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text in UTF-8, in order, repeats included."""
    words = raw.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is set where over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    for i, raw in enumerate(texts):
        hashes = np.array(shingle_hashes(raw, width), np.uint64)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(hashes):
            out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


_ODD = np.uint64(0x5555555555555555)


def embed(prints: np.ndarray) -> np.ndarray:
    """The counts of the segments of two bits, packed in place of the segments."""
    return (prints & _ODD) + ((prints >> np.uint64(1)) & _ODD)


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The radius-1 balls of the pairs of blocks of the embeddings: cell numbers and the index of their fingerprint."""
    packed, keys, owners = embed(prints), [], []
    everyone = np.arange(len(prints))
    one, three = np.uint64(1), np.uint64(3)
    for low, high in BLOCKS:
        # The counts of the block left out are at most 2 each, so all ones mark it.
        block = np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))
        own = packed | block
        keys.append(own)
        owners.append(everyone)
        for at in [*range(0, low, 2), *range(high, 64, 2)]:
            shift = np.uint64(at)
            count, step = (own >> shift) & three, one << shift
            for able, moved in ((count < 2, own + step), (count > 0, own - step)):
                keys.append(moved[able])
                owners.append(everyone[able])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def forest(prints: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, edges = prints, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = np.bitwise_count(left ^ here) <= bits
            if near.any():
                found = left[near]
                frontier.extend(found)
                edges.extend((int(here), int(x)) for x in found)
                left = left[~near]
    return edges


def links_in_cells(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of cells that lie whole in sorted `keys`."""
    ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    left, right = [], []
    rest = np.repeat(ends, sizes)
    index, long = np.arange(len(keys)), np.repeat(sizes > SHORT, sizes)
    for d in range(1, SHORT):
        i = index[(index + d < rest) & ~long]
        if not len(i):
            break
        near = np.bitwise_count(prints[i] ^ prints[i + d]) <= MAX_BITS
        left.append(prints[i[near]])
        right.append(prints[i[near] + d])
    for a, b in zip(starts[sizes > SHORT], ends[sizes > SHORT], strict=True):
        if edges := forest(prints[a:b]):
            pairs = np.array(edges, np.uint64)
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        found = fingerprints(rt.texts_as_bytes(batch.column("text"))).view(np.int64)
        yield pa.record_batch([batch.column("__dl_uid"), batch.column("doc_id"), pa.array(found)], names=["__dl_uid", "doc_id", "fp"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            keys, owners = cells(part)
            yield pa.record_batch([pa.array(keys), pa.array(part[owners].view(np.int64))], names=["cell", "fp"])


def _links(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the cells; the members of cells above `block` are handed on as rows (a, cell)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    over = None
    for batch in batches:
        keys, prints = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if over is not None:
            cut = int(np.searchsorted(keys, over, "right"))
            yield _members(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
        if not len(keys):
            continue
        over = None
        held.append((keys, prints))
        if keys[-1] == held[0][0][0] and sum(len(x) for x, _ in held) <= block:
            continue
        keys, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if len(keys) - cut > block:
            over, cut = keys[-1], len(keys)
        held = [(keys[cut:], prints[cut:])] if cut < len(keys) else []
        yield from _edges(keys[:cut], prints[:cut], block)
    if held:
        yield from _edges(*(np.concatenate(x) for x in zip(*held, strict=True)), block)


def _edges(keys: np.ndarray, prints: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    sizes = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))
    if (sizes > block).any():
        large = np.repeat(sizes > block, sizes)
        yield _members(keys[large], prints[large])
        keys, prints = keys[~large], prints[~large]
    if len(keys):
        yield _pairs(*links_in_cells(keys, prints))


def _members(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(prints.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(keys)], names=["a", "b", "cell"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "cell"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each run of rows with equal (cell, low, high)."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "low", "high")], axis=1)
        prints = batch.column("fp").to_numpy().view(np.uint64)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if last is not None and (keys[a] != last).any():
                yield _grown(held)
                held = []
            last = keys[a]
            held.append(prints[a:b])
    if held:
        yield _grown(held)


def _grown(held: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.array(forest(np.concatenate(held)), np.uint64).reshape(-1, 2)
    return _pairs(pairs[:, 0], pairs[:, 1]).select(["a", "b"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Row id, doc_id and fingerprint `fp` of each row; written once."""
    rt.prepare(docs.sparkSession)
    rows = rt.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "__dl_uid")
    return rt.materialise(rows.select("__dl_uid", "doc_id", "text").mapInArrow(_prints, "__dl_uid long, doc_id long, fp long"), "prints")


def link_edges(prints: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the `n` distinct fingerprints that span all links within MAX_BITS.

    Cells above `block` members are cut into blocks by a hash; each pair of
    blocks is searched in a task of its own.
    """
    spark = prints.sparkSession
    parts = rt.tasks_for(spark, 100 * n, 4 * rt.ROWS_PER_TASK)
    spread = prints.mapInArrow(_cells, "cell long, fp long").repartition(parts, "cell").sortWithinPartitions("cell")
    found = rt.materialise(spread.mapInArrow(lambda batches: _links(batches, block), "a long, b long, cell long"), "links")
    edges = found.where("cell is null").select("a", "b")
    members = found.where("cell is not null").select("cell", F.col("a").alias("fp"))
    sizes = rt.materialise(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "sizes")
    rows = sizes.agg(F.sum(F.col("n") * (F.col("parts") - 1))).first()[0]
    if not rows:
        return edges
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = members.join(sizes, "cell").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.where("other <> block").select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    tasks = rt.tasks_for(spark, rows, 2 * block)
    pieces = dealt.repartition(tasks, "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return edges.unionByName(pieces.mapInArrow(_searched, "a long, b long"))


def classed(rows: DataFrame) -> DataFrame:
    """The rows of `fingerprinted()` with component_id and the row id that stands for the component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__dl_uid").alias("uid")))
    with rt.passing():
        distinct = rt.materialise(rows.groupBy(F.col("fp").alias("node")).agg(first.alias("first")), "distinct")
        roots = components(link_edges(distinct.select(F.col("node").alias("fp")), distinct.count()))
        owner = rt.materialise(headed(distinct, roots).select(F.col("node").alias("fp"), "head"), "owner")
    return rows.join(owner, "fp").select("__dl_uid", "doc_id", "fp", F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("__dl_head"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    return classed(fingerprinted(docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
