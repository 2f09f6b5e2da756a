"""Near copies by shingle similarity: SimHash through the segment-popcount embedding, then an exact check.

Two documents are linked if the sets of their five-word shingles have a Jaccard
similarity of at least LEAST. The steps are those of `simhash`, on a longer
fingerprint, since at 0.8 up to 15.2 % of the bits of a SimHash differ.

1. Fingerprint: each shingle's hash is mixed into WORDS words; a bit is set where
   over half of the distinct shingles have it. The first HEAD words are the head,
   which travels; the others serve the grid.
2. Embedding: segments of two bits and their bit counts. A segment keeps its
   count with probability 0.73 at similarity 0.8 and 0.375 between strangers.
3. Grid: a table takes COORDS counts, and the logarithm of the number of shingles
   in steps of three times log(1 / LEAST) from an offset of its own, as coordinates
   of a cell; each fingerprint enters one cell in each of TABLES tables.
   Fingerprints of up to FEW shingles, whose bits can differ more, enter three times as many.
4. Hamming check: heads of one cell are linked if they differ in at most BITS bits.
   Spanning forests of these links give components of candidates. The components of
   the first tables are handed to the later ones, which look only for links between
   different components.
5. Exact check: inside a component of candidates, sets are compared by the exact
   similarity, after the bound that the counts of SEGMENTS segments of the set
   itself (a bit vector with one bit for each possible hash) give: the Manhattan
   distance never exceeds the number of differing shingles, at most
   (1 - LEAST) / (1 + LEAST) * (a + b) for sets of a and b. The components of
   these links are the result.

Only steps 3 and 4 can miss a pair. Of simulated pairs at exactly 0.8 and of 1,000
shingles, none of 3,000 at equal sizes and none of 20,000 where one set holds the
other shared no cell; by estimate the latter is 3e-5. By calculation the heads of a pair at 0.8 differ in more than BITS bits
with probability 4e-8 (4e-5 for four shingles of five). A pair that is missed is still
found if others join its two documents, as components are searched whole.

Documents with equal sets fold to one node first. Inside a component of
candidates a frontier search compares each member with those not reached yet, so
near copies cost about as many steps as there are members and yield a spanning
forest, not all pairs; members that stay unlinked are all compared. Cells above
CELL members that LEADS of their members do not join, and components above BLOCK
members or BLOCK_BYTES, are cut into blocks by a hash, and each pair of blocks is
searched in a task of its own, so none is held whole. The tables are filled in
steps (ENDS), and the shuffle files of a step are deleted with it.

Defined results: as in `simhash`: null text counts as empty; texts without words
have equal, empty sets and are linked; texts are read whole; repeated rows are
copies of each other; the first document (by doc_id, nulls last) of a component
stays; an empty table gives an empty result; other columns, of any name, are
handed on unchanged.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt
from .graph import components, headed
from .simhash import SHORT, shingle_hashes
from .simhash import embed as segment_counts

WIDTH, LEAST = 5, 0.8
#: Words of 64 bits of a fingerprint, those of its head, and the most bits that heads of linked documents differ in.
WORDS, HEAD, BITS = 33, 3, 58
#: Tables of the grid, segments that each takes as coordinates, and most tables filled at a time.
TABLES, COORDS, STEP = 384, 10, 48
#: Tables filled after each step: few at first, as before the first components are known every table joins a group anew.
ENDS = (8, *range(STEP, TABLES + 1, STEP))
#: Steps after which the components are found again.
ROOTED = 2
#: Sets of up to so many shingles enter twice as many tables besides.
FEW = 8
#: Members of a cell whose heads are compared in one piece, those of a larger one that are compared with all first, and those compared in one vector step.
CELL, LEADS, WIDE = 1 << 14, 256, 512
#: Members of a part of a table on average, and those above which a part is not held whole.
PART, HELD = 250_000, 4_000_000
#: Segments of a shingle set: a power of two.
SEGMENTS = 128
#: Members and bytes of shingle hashes of a component of candidates that is searched in one piece.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, (WORDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (WORDS, 1), np.uint64)
_PLACES = np.stack([_RNG.choice((WORDS - HEAD) * 32, COORDS, replace=False) for _ in range(3 * TABLES)])
_OFFSETS = _RNG.random(3 * TABLES)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(raw, width), np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """A bit is set where over half of the mixed hashes have it."""
    ones = np.zeros((WORDS, 8, 8), np.int64)
    for at in range(0, len(found), 255):
        mixed = found[at : at + 255] * _TIMES + _PLUS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for bit in range(8):
            # Eight counts at once, one in each byte: 255 ones at most.
            lanes = (mixed >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            ones[:, :, bit] += lanes.sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(WORDS, 8)
    return np.packbits((2 * ones > len(found)).reshape(WORDS, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]


def cells(prints: np.ndarray, sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The cell of each fingerprint in each of some tables: step of the size and counts as one number below 2^32."""
    packed = np.ascontiguousarray(segment_counts(prints[:, HEAD:])).view(np.uint8)
    counts = np.stack([(packed >> np.uint8(at)) & np.uint8(3) for at in (0, 2, 4, 6)], axis=2).reshape(len(prints), -1)
    keys = np.zeros((len(prints), len(tables)), np.int64)
    for places in _PLACES[tables].T:
        keys = keys * 4 + counts[:, places]
    steps = np.log(np.maximum(sizes, 1)) / (3 * np.log(1 / LEAST))
    return np.floor(steps[:, None] + _OFFSETS[tables]).astype(np.int64) << 2 * COORDS | keys


def _away(heads: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of heads, word by word."""
    return sum(np.bitwise_count(heads[..., i] ^ other[..., i]).astype(np.int16) for i in range(heads.shape[-1]))


def close_heads(heads: np.ndarray, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (by place) of a spanning forest of the heads within BITS; those with equal `roots` count as joined."""
    return _grow(heads, np.arange(len(heads)) if roots is None else roots)[0]


def _grow(heads: np.ndarray, roots: np.ndarray, most: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges (by place) of a forest, and the roots with it; after `most` members have been compared with all left the search ends."""
    names, codes = np.unique(roots, return_inverse=True)
    joined, edges, near = np.arange(len(names)), [], None
    if len(names) < 2:
        return edges, roots
    if len(heads) <= WIDE:
        near = _away(heads[:, None], heads[None]) <= BITS
        if near.sum() == len(heads):
            return edges, roots
    left, popped = np.arange(len(heads)), 0
    while len(left):
        own = codes[left[0]]
        same = codes[left] == own
        frontier, left = left[same].tolist(), left[~same]
        while frontier and len(left):
            if popped == most:
                return edges, names[joined[codes]]
            popped += 1
            here = frontier.pop()
            found = left[near[here, left] if near is not None else _away(heads[left], heads[here]) <= BITS]
            if len(found):
                new, at = np.unique(codes[found], return_index=True)
                joined[new] = own
                edges.extend((here, x) for x in found[at].tolist())
                same = joined[codes[left]] == own
                frontier.extend(left[same].tolist())
                left = left[~same]
    return edges, names[joined[codes]]


def close_in_cells(keys: np.ndarray, heads: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked heads, of different `roots`, of cells that lie whole in sorted `keys`."""
    ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.repeat(ends, sizes)
    index, long = np.arange(len(keys)), np.repeat(sizes > SHORT, sizes)
    first = index.copy()
    for d in range(1, SHORT):
        i = index[(index + d < rest) & ~long]
        if not len(i):
            break
        i = i[roots[i] != roots[i + d]]
        near = i[_away(heads[i], heads[i + d]) <= BITS]
        first[near + d] = near
        left.append(near)
        right.append(near + d)
    # An edge between two members with the same first neighbour adds nothing to theirs.
    a, b = np.concatenate(left), np.concatenate(right)
    needed = (a == first[b]) | (first[a] != first[b])
    left, right = [a[needed]], [b[needed]]
    for a, b in zip(starts[sizes > SHORT].tolist(), ends[sizes > SHORT].tolist(), strict=True):
        if edges := close_heads(heads[a:b], roots[a:b]):
            pairs = np.array(edges, np.int64) + a
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
    return np.concatenate(left), np.concatenate(right)


def embed(found: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Bit counts of the segments of a set of hashes."""
    return np.bincount((found >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64), minlength=segments).astype(np.int32)


def forest(sets: list[np.ndarray], least: float = LEAST, blocks: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (by place) of a spanning forest of the similar sets.

    With `blocks`, only members of different blocks are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = np.stack([embed(s) for s in sets])
    side = np.zeros(len(sets), np.int64) if blocks is None else np.array(blocks)
    bound = (1 - least) / (1 + least)
    left, edges = np.arange(len(sets)), []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            both = sizes[left] + sizes[here]
            able = np.abs(sizes[left] - sizes[here]) <= bound * both + 1e-6
            if blocks is not None:
                able &= side[left] != side[here]
            able[able] = np.abs(counts[left[able]] - counts[here]).sum(axis=1) <= bound * both[able] + 1e-6
            if not able.any():
                continue
            near = left[able]
            near = near[_overlaps(sets, here, near) >= least * (sizes[near] + sizes[here]) / (1 + least) - 1e-6]
            if len(near):
                frontier.extend(near.tolist())
                edges.extend((here, x) for x in near.tolist())
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def _overlaps(sets: list[np.ndarray], here: int, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one set with others."""
    own = sets[here]
    if not len(own):
        return np.zeros(len(others), np.int64)
    flat = np.concatenate([sets[i] for i in others])
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    hit = np.concatenate([[0], np.cumsum(own[place] == flat)])
    ends = np.cumsum([len(sets[i]) for i in others])
    return hit[ends] - hit[np.concatenate([[0], ends[:-1]])]


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        sets = [shingles(raw, width) for raw in rt.texts_as_bytes(batch.column("text"))]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = [fingerprint(s) for s in sets]
        heads = pa.array(np.array([x[0] for x in prints], np.uint64).view(np.int64))
        sizes, prints = pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in prints], pa.binary())
        columns = [batch.column("__dl_uid"), batch.column("doc_id"), pa.array(nodes), sizes, heads, prints]
        yield pa.record_batch(columns, names=["__dl_uid", "doc_id", "node", "size", "head", "print"])


_HEAD = [f"head{i}" for i in range(HEAD)]
_HEADS = ", ".join(f"{c} long" for c in _HEAD)


def _cells(batches: Iterator[pa.RecordBatch], tables: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The members of some tables, by parts of a table: their number, and all cells, then all heads, then all known roots in one value.

    Members whose root is known come first; the root of the others is the first word of their head.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            piece = piece.take(pa.array(np.argsort(piece.column("root").is_null().to_numpy(zero_copy_only=False), kind="stable")))
            roots = piece.column("root").drop_null().to_numpy()
            prints = np.frombuffer(b"".join(piece.column("print").to_pylist()), np.uint64).reshape(-1, WORDS)
            sizes = piece.column("size").to_numpy()
            few = sizes <= FEW
            numbers, counts, values = [], [], []
            for some, which in ((np.ones(len(sizes), bool), tables), (few, np.concatenate([tables + TABLES, tables + 2 * TABLES]))):
                if not some.any():
                    continue
                heads, known = np.ascontiguousarray(prints[some, :HEAD]), roots[some[: len(roots)]]
                for table, keys in zip(which.tolist(), cells(prints[some], sizes[some], which).T.astype(np.uint32), strict=True):
                    own = (keys * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(parts)
                    for part in np.unique(own).tolist():
                        inside = own == part
                        numbers.append(table * parts + part)
                        counts.append(int(inside.sum()))
                        values.append(keys[inside].tobytes() + heads[inside].tobytes() + known[inside[: len(known)]].tobytes())
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(counts, pa.int32()), pa.array(values, pa.binary())], names=["part", "n", "members"])


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in _HEAD], axis=1).view(np.uint64)


def _close(batches: Iterator[pa.RecordBatch], block: int, limit: int, leads: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the cells, between roots.

    The members of cells above `block` that `leads` of them do not join, and of parts above `limit`, are handed on with their cell.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last, n = None, 0
    for batch in batches:
        for part, m, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "members")), strict=True):
            if part != last:
                yield from _whole(last, held, block, leads)
                held, last, n = [], part, 0
            heads = np.frombuffer(raw, np.uint64, m * HEAD, 4 * m).reshape(m, HEAD)
            roots, known = heads[:, 0].astype(np.int64), np.frombuffer(raw[(4 + 8 * HEAD) * m :], np.int64)
            roots[: len(known)] = known
            held.append((np.frombuffer(raw, np.uint32, m), heads, roots))
            n += m
            if n > limit:
                for keys, heads, roots in held:
                    yield _found(part << 32 | keys.astype(np.int64), heads, roots)
                held = []
    yield from _whole(last, held, block, leads)


def _whole(part: int | None, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int, leads: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    keys, heads, roots = (np.concatenate(x) for x in zip(*held, strict=True))
    # Sorted by head too, so that the trees of all tables start from the same members.
    order = np.lexsort((heads[:, 0], keys))
    keys, heads, roots = part << 32 | keys[order].astype(np.int64), heads[order], roots[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
    for a, n in zip(starts[mixed & (sizes > block)].tolist(), sizes[mixed & (sizes > block)].tolist(), strict=True):
        cell = slice(a, a + n)
        edges, after = _grow(heads[cell], roots[cell], leads)
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        yield _linked(roots[cell], pairs[:, 0], pairs[:, 1])
        if (after != after[0]).any():
            yield _found(keys[cell], heads[cell], after)
    small = np.repeat(mixed & (sizes <= block), sizes)
    if small.any():
        yield _linked(roots[small], *close_in_cells(keys[small], heads[small], roots[small]))


def _found(keys: np.ndarray, heads: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    words = [pa.array(np.ascontiguousarray(heads[:, i]).view(np.int64)) for i in range(HEAD)]
    none = pa.nulls(len(keys), pa.int64())
    return pa.record_batch([none, none, pa.array(keys), pa.array(roots), *words], names=["a", "b", "cell", "root", *_HEAD])


def _linked(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    a, b = roots[left], roots[right]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    none = pa.nulls(len(pairs), pa.int64())
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, *[none] * HEAD], names=["a", "b", "cell", "root", *_HEAD])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each run of rows with equal (cell, low, high)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        keys, heads, roots = np.stack([batch.column(c).to_numpy() for c in ("cell", "low", "high")], axis=1), _heads(batch), batch.column("root").to_numpy()
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if last is not None and (keys[a] != last).any():
                yield _grown(held)
                held = []
            last = keys[a]
            held.append((heads[a:b], roots[a:b]))
    if held:
        yield _grown(held)


def _grown(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    heads, roots = (np.concatenate(x) for x in zip(*held, strict=True))
    pairs = np.array(close_heads(heads, roots), np.int64).reshape(-1, 2)
    return _linked(roots, pairs[:, 0], pairs[:, 1]).select(["a", "b"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with the first word of their head."""
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, WORDS)
        heads = pa.array(np.ascontiguousarray(prints[:, 0]).view(np.int64))
        yield pa.record_batch([heads, batch.column("print"), batch.column("size")], names=["head", "print", "size"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's edges: the trees of different tables mostly join the same members."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    for batch in batches:
        edges = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            if low != high:
                up[high] = low
                edges.append((a, b))
        yield _table(edges)


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside the block are deleted with it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    former = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if former is None else spark.conf.set(key, former)


def candidate_edges(prints: DataFrame, n: int, block: int = CELL, limit: int = HELD, leads: int = LEADS) -> DataFrame:
    """Edges (a, b) between the first words of the heads of `n` fingerprints (print, size) that span all links within BITS.

    After each of the first ROOTED steps the edges so far are replaced by those of
    their components' members to the root, and the members carry their root on.
    Cells above `block` members that `leads` of them do not join are cut into blocks
    by a hash; each pair of blocks is searched in a task of its own. So are the cells
    of parts above `limit`.
    """
    spark = prints.sparkSession
    prints = prints.select("print", "size")
    rooted = prints.withColumn("root", F.lit(None).cast("long"))
    tasks = rt.tasks_for(spark, STEP * n, 4 * rt.ROWS_PER_TASK)
    every: list[DataFrame] = []
    written: DataFrame | None = None
    for step, (first, end) in enumerate(itertools.pairwise((0, *ENDS))):
        # In a step of few tables each has more parts, so that all cores have some.
        tables, parts = np.arange(first, end), max(1, -(-n // PART)) * max(1, STEP // (end - first))
        entered = rooted.mapInArrow(lambda batches, tables=tables, parts=parts: _cells(batches, tables, parts), "part long, n int, members binary")
        spread = entered.repartition(tasks, "part").sortWithinPartitions("part")
        kinds = f"a long, b long, cell long, root long, {_HEADS}"
        found = rt.materialise(spread.mapInArrow(lambda batches: _close(batches, block, limit, leads), kinds), "close")
        every.append(found.where("cell is null").select("a", "b"))
        every.extend(_cut(found.where("cell is not null").select("cell", "root", *_HEAD), block))
        if step < ROOTED:
            roots = components(functools.reduce(DataFrame.unionByName, every)).where("node <> root")
            every = [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            named = prints.mapInArrow(_named, "head long, print binary, size long")
            joined = named.join(roots.withColumnRenamed("node", "head"), "head", "left").select("print", "size", "root")
            former, written = written, rt.materialise(joined, "rooted")
            rooted = written
            if former is not None:
                rt.discard(former)
    rt.discard(written)
    out = functools.reduce(DataFrame.unionByName, every)
    return out.coalesce(max(1, -(-out.count() // rt.ROWS_PER_TASK))).mapInArrow(_folded, "a long, b long")


def _cut(members: DataFrame, block: int) -> list[DataFrame]:
    """Edges (a, b) of the cells that were handed on, if any: cut into blocks, each pair of blocks in a task of its own."""
    spark = members.sparkSession
    counts = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    sizes = rt.materialise(counts.where("least < most").select("cell", "n", F.ceil(F.col("n") / block).cast("int").alias("parts")), "sizes")
    rows = sizes.agg(F.sum(F.col("n") * F.greatest(F.col("parts") - 1, F.lit(1)))).first()[0]
    if not rows:
        return []
    own = F.pmod(F.xxhash64(*_HEAD), F.col("parts")).cast("int")
    dealt = members.join(sizes, "cell").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.where("other <> block or parts = 1").select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "root", *_HEAD)
    pieces = dealt.repartition(rt.tasks_for(spark, rows, 2 * block), "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return [rt.materialise(pieces.mapInArrow(_pieces, "a long, b long"), "pieces")]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        found = [shingles(raw, width).tobytes() for raw in rt.texts_as_bytes(batch.column("text"))]
        yield pa.record_batch([batch.column("node"), pa.array(found, pa.binary())], names=["node", "found"])


def _searched(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Edges of each run of rows with equal (cell, low, high)."""
    held: list[tuple[int, int, bytes]] = []
    last = None
    for batch in rt.slices(batches, "found", 16 << 20):
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high")), strict=True))
        nodes, blocks, found = (batch.column(c).to_pylist() for c in ("node", "block", "found"))
        edges: list[tuple[int, int]] = []
        for key, row in zip(keys, zip(nodes, blocks, found, strict=True), strict=True):
            if key != last:
                edges += _edges(last, held, least)
                last, held = key, []
            held.append(row)
        yield _table(edges)
    yield _table(_edges(last, held, least))


def _edges(key: tuple[int, int, int] | None, rows: list[tuple[int, int, bytes]], least: float) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    sets = [np.frombuffer(x[2], np.uint64) for x in rows]
    blocks = None if key[1] == key[2] else [x[1] for x in rows]
    return [(rows[a][0], rows[b][0]) for a, b in forest(sets, least, blocks)]


def _table(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def link_edges(distinct: DataFrame, rows: DataFrame, width: int, least: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) between nodes that span all links of nodes that share a cell, here a component of candidates.

    `distinct` holds node, size, cells and the row id `uid` of a text of each
    node; `rows` holds `__dl_uid` and text.
    """
    spark = distinct.sparkSession
    every = distinct.select("node", "size", F.explode("cells").alias("cell"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    shared = every.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes"), *marks).where("n > 1")
    once = shared.groupBy("n", "bytes", "mark1", "mark2").agg(F.min("cell").alias("cell"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("parts")
    once = rt.materialise(once.select("cell", parts), "shared")
    members = rt.materialise(every.join(once, "cell").select("cell", "parts", "node"), "members")
    wanted = members.select("node").distinct().join(distinct.select("node", F.col("uid").alias("__dl_uid")), "node")
    texts = rows.select("__dl_uid", "text").join(wanted, "__dl_uid").select("node", "text")
    sets = rt.materialise(texts.mapInArrow(lambda batches: _sets(batches, width), "node long, found binary"), "sets")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    dealt = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")
    joined = dealt.join(sets, "node").select("cell", "low", "high", "block", "node", "found")
    tasks = rt.tasks_for(spark, members.count(), 50_000)
    grouped = joined.repartition(tasks, "cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node")
    return grouped.mapInArrow(lambda batches: _searched(batches, least), "a long, b long")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of `docs` without all but the first document of each component of similar ones; `least` is LEAST or more."""
    if least < LEAST:
        raise ValueError(f"the grid serves similarities of {LEAST} or more")
    rt.prepare(docs.sparkSession)
    rows, uid = rt.numbered(docs, "near")
    source = rows.select(rt.quoted(uid).alias("__dl_uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with rt.passing(), _swept(docs.sparkSession):
        kinds = "__dl_uid long, doc_id long, node long, size long, head long, print binary"
        signed = rt.materialise(source.mapInArrow(lambda batches: _signed(batches, width), kinds), "signed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__dl_uid").alias("uid")))
        picked = [first.alias("first"), *(F.first(c).alias(c) for c in ("size", "head", "print"))]
        distinct = rt.materialise(signed.groupBy("node").agg(*picked), "distinct")
        roots = rt.materialise(components(candidate_edges(distinct, distinct.count())), "roots")
        cells = F.array(F.coalesce("root", "head")).alias("cells")
        held = distinct.join(roots.select(F.col("node").alias("head"), "root"), "head", "left")
        held = rt.materialise(held.select("node", "size", "first", F.col("first.uid").alias("uid"), cells), "candidates")
        edges = link_edges(held, source.select("__dl_uid", "text"), width, least)
        owner = rt.materialise(headed(held.select("node", "first"), components(edges)), "owner")
        gone = signed.select("__dl_uid", "node").join(owner, "node").where("__dl_uid <> head.uid").select("__dl_uid")
        gone = rt.materialise(gone, "gone")
    return rt.without(rows, uid, gone)
