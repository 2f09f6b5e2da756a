"""Exact deduplication through a cuckoo-filter index of text digests.

Each text is normalised (white space of the class [\\x20\\x09-\\x0D] deleted)
and reduced to its SHA-256. Digests are dealt to tasks by value; every task
keeps a `CuckooIndex`: a cuckoo filter of 16-bit fingerprints whose slots point
at the stored 32-byte keys. A filter hit only counts once the stored key of
that bucket equals the digest in full; a full filter is rebuilt at twice the
size from the stored keys. `LiveIndex` keeps such an index as a table that
accepts further insertions and deletions.

Defined results: null text counts as empty; null doc_id sorts after all others;
of rows equal in text, length and doc_id exactly one (any) stays; texts of any
length are read whole; an empty table gives an empty result; other columns, of
any name, are ignored (marking) or handed on unchanged (dropping).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

SLOTS = 4
MAX_KICKS = 400


class CuckooIndex:
    """Cuckoo filter over 32-byte digests, with the digests themselves behind its slots.

    Keys live in `keys` (four 64-bit words each). `tags[b, s]` is the 16-bit
    fingerprint in slot s of bucket b (0: free), `refs[b, s]` the key's number.
    A key's two buckets are h and h xor mix(tag), so an entry moves knowing
    only its tag.
    """

    def __init__(self, expected: int = 1024):
        self.keys = np.zeros((max(16, expected), 4), np.uint64)
        self.live = np.zeros(len(self.keys), bool)
        self.used = 0
        self.free: list[int] = []
        self.resizes = 0
        self._allot(max(4, int(expected / (SLOTS * 0.85)) + 1))

    def _allot(self, buckets: int) -> None:
        n = 1 << (buckets - 1).bit_length()
        self.mask = np.uint64(n - 1)
        self.tags = np.zeros((n, SLOTS), np.uint16)
        self.refs = np.zeros((n, SLOTS), np.int64)

    def __len__(self) -> int:
        return int(self.live[: self.used].sum())

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        one = (keys[:, 0] & self.mask).astype(np.int64)
        return tag, one, self._other(one, tag)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        mixed = (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ mixed) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each key its flat slot (-1: absent) and its number; the count of refuted filter hits."""
        tag, one, two = self._place(keys)
        slot, ref, refuted = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64), 0
        for bucket in (one, two):
            rows, cols = np.nonzero((self.tags[bucket] == tag[:, None]) & (slot < 0)[:, None])
            got = self.refs[bucket[rows], cols]
            same = (self.keys[got] == keys[rows]).all(axis=1)
            refuted += int((~same).sum())
            rows, cols, got = rows[same], cols[same], got[same]
            slot[rows], ref[rows] = bucket[rows] * SLOTS + cols, got
        return slot, ref, refuted

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Add keys that differ from each other and from all stored ones; gives their numbers."""
        numbers = self._store(keys)
        if not self._link(numbers):
            self.resize()
        return numbers

    def _store(self, keys: np.ndarray) -> np.ndarray:
        again = [self.free.pop() for _ in range(min(len(self.free), len(keys)))]
        fresh = len(keys) - len(again)
        while self.used + fresh > len(self.keys):
            self.keys = np.vstack([self.keys, np.zeros_like(self.keys)])
            self.live = np.concatenate([self.live, np.zeros_like(self.live)])
        numbers = np.array([*again, *range(self.used, self.used + fresh)], np.int64)
        self.used += fresh
        self.keys[numbers], self.live[numbers] = keys, True
        return numbers

    def _link(self, numbers: np.ndarray) -> bool:
        tag, one, two = self._place(self.keys[numbers])
        tags, refs = self.tags.reshape(-1), self.refs.reshape(-1)
        waiting = np.arange(len(numbers))
        while len(waiting):
            room1, room2 = (self.tags[one[waiting]] == 0), (self.tags[two[waiting]] == 0)
            first = room1.any(axis=1)
            bucket = np.where(first, one[waiting], two[waiting])
            cell = bucket * SLOTS + np.where(first, room1.argmax(axis=1), room2.argmax(axis=1))
            fits = first | room2.any(axis=1)
            stuck, able, cell = waiting[~fits], waiting[fits], cell[fits]
            _, winners = np.unique(cell, return_index=True)
            tags[cell[winners]], refs[cell[winners]] = tag[able[winners]], numbers[able[winners]]
            for i in stuck:
                if not self._kick(int(tag[i]), int(numbers[i]), int(one[i])):
                    return False
            waiting = np.delete(able, winners)
        return True

    def _kick(self, tag: int, ref: int, bucket: int) -> bool:
        for turn in range(MAX_KICKS):
            room = np.flatnonzero(self.tags[bucket] == 0)
            if len(room):
                self.tags[bucket, room[0]], self.refs[bucket, room[0]] = tag, ref
                return True
            slot = (turn + ref) % SLOTS
            evicted = int(self.tags[bucket, slot]), int(self.refs[bucket, slot])
            self.tags[bucket, slot], self.refs[bucket, slot] = tag, ref
            tag, ref = evicted
            bucket = int(self._other(np.array([bucket]), np.array([tag], np.uint16))[0])
        return False

    def resize(self) -> None:
        """Rebuild the filter at twice the size from the stored keys until all fit."""
        numbers = np.flatnonzero(self.live[: self.used])
        while True:
            self.resizes += 1
            self._allot(2 * len(self.tags))
            if self._link(numbers):
                return

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Remove stored keys, given once each; tells which were present."""
        slot, ref, _ = self.find(keys)
        there = slot >= 0
        self.tags.reshape(-1)[slot[there]] = 0
        self.live[ref[there]] = False
        self.free.extend(ref[there].tolist())
        return there


def digest_words(column: pa.Array) -> np.ndarray:
    """32-byte binary values as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4).astype(np.uint64)


def digests(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """doc_id, n_points (code points of the text) and digest of each row, and its row id `__dl_uid`; written once.

    `uid` names the column of `docs` that holds the row id; without it, one is made.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, rt.ASCII_SPACE, "")
    row = F.monotonically_increasing_id() if uid is None else rt.quoted(uid)
    return rt.materialise(
        docs.select(
            row.alias("__dl_uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(text).cast("long").alias("n_points"),
            F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )


_GROUP = "digest binary, n_points long, doc_id long, uid long, size long"
_LAST = np.iinfo(np.int64).max


def _fold(best: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Merge candidates (size, -points, doc_id, uid) into best[at], several per place allowed."""
    if not len(at):
        return
    order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], at))
    at, rows = at[order], rows[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    places, first, old = at[starts], rows[starts], best[at[starts]]
    less, same = np.zeros(len(places), bool), np.ones(len(places), bool)
    for column in (1, 2, 3):
        less |= same & (first[:, column] < old[:, column])
        same &= first[:, column] == old[:, column]
    better = less | (old[:, 0] == 0)
    best[places[better], 1:] = first[better, 1:]
    best[places, 0] += np.add.reduceat(rows[:, 0], starts)


def _candidates(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column("doc_id")
    return np.stack(
        [
            batch.column("size").to_numpy(zero_copy_only=False),
            -batch.column("n_points").to_numpy(zero_copy_only=False),
            pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False),
            batch.column("uid").to_numpy(zero_copy_only=False),
        ],
        axis=1,
    ).astype(np.int64)


def _emit(keys: np.ndarray, best: np.ndarray, least: int = 1) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(keys), 50_000):
        part, rows = keys[start : start + 50_000], best[start : start + 50_000]
        part, rows = part[rows[:, 0] >= least], rows[rows[:, 0] >= least]
        raw = part.astype("<u8").tobytes()
        ids = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 2] == _LAST)
        yield pa.record_batch(
            [pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(-rows[:, 1]), ids, pa.array(rows[:, 3]), pa.array(rows[:, 0])],
            names=["digest", "n_points", "doc_id", "uid", "size"],
        )


def _index(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    index, best = CuckooIndex(), np.zeros((1024, 4), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, inverse = np.unique(digest_words(batch.column("digest")), axis=0, return_inverse=True)
        _, ref, _ = index.find(keys)
        new = ref < 0
        ref[new] = index.insert(keys[new])
        while len(best) < index.used:
            best = np.vstack([best, np.zeros_like(best)])
        _fold(best, ref[inverse.reshape(-1)], _candidates(batch))
    yield from _emit(index.keys[: index.used], best[: index.used], least)


def _within_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the copies inside each Arrow batch, so that a hot text reaches the shuffle once a batch."""
    for batch in batches:
        if batch.num_rows:
            keys, inverse = np.unique(digest_words(batch.column("digest")), axis=0, return_inverse=True)
            best = np.zeros((len(keys), 4), np.int64)
            _fold(best, inverse.reshape(-1), _candidates(batch))
            yield from _emit(keys, best)


def groups(rows: DataFrame, n: int, least: int = 2) -> DataFrame:
    """Digest, keeper and size of each group of at least `least` rows, found through cuckoo indexes."""
    spark = rt.prepare(rows.sparkSession)
    shaped = rows.select("digest", "n_points", "doc_id", F.col("__dl_uid").alias("uid"), F.lit(1).cast("long").alias("size"))
    dealt = shaped.mapInArrow(_within_batch, _GROUP).repartition(rt.tasks_for(spark, n), F.xxhash64("digest"))
    return dealt.mapInArrow(lambda it: _index(it, least), _GROUP)


def assign(rows: DataFrame) -> DataFrame:
    """Each row of `digests()` with keep_id, group_size and kept."""
    found = groups(rows, rows.count()).select(
        "digest", F.col("doc_id").alias("__dl_keep"), F.col("uid").alias("__dl_keeper"), F.col("size").alias("__dl_size")
    )
    joined = rows.join(found, "digest", "left")
    alone = F.col("__dl_keeper").isNull()
    return joined.select(
        "__dl_uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__dl_keep")).alias("keep_id"),
        F.coalesce("__dl_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__dl_keeper") == F.col("__dl_uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def mark_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return assign(digests(docs)).drop("__dl_uid")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    rows, uid = rt.numbered(docs, "exact")
    with rt.passing():
        gone = rt.materialise(assign(digests(rows, uid)).where(~F.col("kept")).select("__dl_uid"), "gone")
    return rt.without(rows, uid, gone)


class LiveIndex:
    """A cuckoo index kept as a table: Parquet rows (digest, refs), bucketed by digest.

    Every change reads the newest generation, applies the change bucket by
    bucket through `CuckooIndex` and writes the next one, so a lost executor
    or a failed job leaves the former generation whole. `refs` counts the live
    rows that carry a digest; deletion lowers it and removes the key at zero.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = rt.prepare(spark)
        self.path = path or f"{rt.scratch_root(spark)}/live-{uuid.uuid4().hex}"
        self.state = spark.createDataFrame([], "digest binary, refs long")
        self.generation = 0

    def _apply(self, docs: DataFrame, sign: int) -> None:
        change = digests(docs).groupBy("digest").agg((F.count(F.lit(1)) * sign).alias("refs"))
        both = self.state.withColumn("stored", F.lit(True)).unionByName(change.withColumn("stored", F.lit(False)))
        parts = rt.tasks_for(self.spark, both.count())
        dealt = both.repartition(parts, F.xxhash64("digest")).sortWithinPartitions(F.desc("stored"))
        self.generation += 1
        path = f"{self.path}/generation={self.generation}"
        dealt.mapInArrow(_changed, "digest binary, refs long").write.parquet(path)
        self.state = self.spark.read.schema("digest binary, refs long").parquet(path)

    def insert(self, docs: DataFrame) -> LiveIndex:
        self._apply(docs, 1)
        return self

    def delete(self, docs: DataFrame) -> LiveIndex:
        self._apply(docs, -1)
        return self

    def probe(self, docs: DataFrame) -> DataFrame:
        """doc_id and `known`: whether the text's digest is in the index, verified in full."""
        rows = digests(docs)
        asked = rows.groupBy("digest").agg(F.lit(0).cast("long").alias("refs")).withColumn("stored", F.lit(False))
        both = self.state.withColumn("stored", F.lit(True)).unionByName(asked)
        parts = rt.tasks_for(self.spark, both.count())
        dealt = both.repartition(parts, F.xxhash64("digest")).sortWithinPartitions(F.desc("stored"))
        hits = dealt.mapInArrow(_probed, "digest binary").withColumn("known", F.lit(True))
        return rows.join(hits, "digest", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


def _bytes(keys: np.ndarray) -> pa.Array:
    raw = keys.astype("<u8").tobytes()
    return pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, refs = CuckooIndex(), np.zeros(1024, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = digest_words(batch.column("digest"))
        keys, inverse = np.unique(keys, axis=0, return_inverse=True)
        by = np.bincount(inverse.reshape(-1), weights=batch.column("refs").to_numpy(), minlength=len(keys)).astype(np.int64)
        _, ref, _ = index.find(keys)
        add = (ref < 0) & (by > 0)
        ref[add] = index.insert(keys[add])
        while len(refs) < index.used:
            refs = np.concatenate([refs, np.zeros_like(refs)])
        refs[ref[add]] = 0
        known = ref >= 0
        refs[ref[known]] += by[known]
        dead = known & (refs[np.maximum(ref, 0)] <= 0)
        index.delete(keys[dead])
    alive = np.flatnonzero(index.live[: index.used])
    yield pa.record_batch([_bytes(index.keys[alive]), pa.array(refs[alive])], names=["digest", "refs"])


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        stored = np.asarray(batch.column("stored").to_pylist(), bool)
        keys = digest_words(batch.column("digest"))
        if stored.any():
            index.insert(keys[stored])
        asked = keys[~stored]
        slot, _, _ = index.find(asked)
        yield pa.record_batch([_bytes(asked[slot >= 0])], names=["digest"])
