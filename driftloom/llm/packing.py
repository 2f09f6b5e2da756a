"""Packing by optimal length buckets.

Token counts of all documents form a global histogram of exact lengths; dynamic
programming over it picks the bucket boundaries with the least padding in total;
inside each bucket documents are dealt to batches of a token budget. The
histogram has one row for each distinct length: with d of them the corpus holds
d * (d + 1) / 2 tokens at least, so 10^13 tokens give 4.5 million rows at most.

Which batch a document enters depends on its doc_id and text alone, so the result
does not change with the layout of the table. Defined results: null text has no
tokens; documents above the budget fill a batch alone; repeated rows are packed
each, in places that are theirs in any order; of cuts with equal padding the one
with the earlier boundary is taken; texts are counted whole, in slices of the
Arrow batches; an empty table gives an empty result; input columns other than
doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as rt
from .bpe import ranks

BUCKETS = 16
TOKEN_BUDGET = 65_536


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str):
    """tiktoken's encoder of a rank file: it counts faster than `bpe.tokenizer`, which gives the same ids (tested)."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(ranks_path), special_tokens={})


def counted(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens and a hash of doc_id and text; written once."""
    rt.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_path).encode_ordinary
        for batch in rt.slices(batches, "text"):
            sizes = [len(encode(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["key", "doc_id", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), "doc_id", text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rt.materialise(rows.mapInArrow(count, f"key long, doc_id {kind}, n_tokens long"), "lengths")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` buckets over ascending lengths with the least padding.

    Padding of a bucket (i, j] is lengths[j] * documents - tokens. For each
    number of buckets the best i for j comes from the lower hull of the lines
    x -> f(i) - documents(i) * x at x = lengths[j]; both are monotone, so a
    layer takes linear time.
    """
    d = len(lengths)
    if not d:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).tolist()
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).tolist()
    ends = lengths.tolist()
    best = [0.0] + [float("inf")] * d
    chosen: list[list[int]] = []
    for _ in range(min(buckets, d)):
        after, back = [float("inf")] * (d + 1), [0] * (d + 1)
        after[0] = 0.0
        hull: list[tuple[float, float, int]] = []  # slope, offset, i; slopes fall
        at = 0
        for j in range(1, d + 1):
            i = j - 1
            if best[i] < float("inf"):
                line = (-docs[i], best[i] + tokens[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            x = ends[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                after[j] = hull[at][0] * x + hull[at][1] + x * docs[j] - tokens[j]
                back[j] = hull[at][2]
        best, chosen = after, [*chosen, back]
    cuts, j = [], d
    for back in reversed(chosen):
        if j <= 0:
            break
        cuts.append(ends[j - 1])
        j = back[j]
    return cuts[::-1]


def pack(docs: DataFrame, ranks_path: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (padded length), batch, slot and padding of each document."""
    rows = counted(docs, ranks_path)
    table = rows.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    lengths, counts = table["n_tokens"].to_numpy(), table["count"].to_numpy()
    cuts = boundaries(lengths, counts, buckets) or [0]
    ends = F.array(*[F.lit(x).cast("long") for x in cuts])
    bucket = F.size(F.filter(ends, lambda x: x < F.col("n_tokens"))).cast("int")
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", F.get(ends, F.col("bucket")))
    placed = rt.ranked(placed, ["bucket"], [F.col("key"), F.col("doc_id")], int(counts.sum()), "__dl_rank")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1)))).cast("long")
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(F.col("__dl_rank") / room).cast("long").alias("batch"),
        F.pmod("__dl_rank", room).cast("int").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
