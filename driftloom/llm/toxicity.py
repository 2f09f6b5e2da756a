"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents are
unlabelled, toxic ones among them. A linear classifier over word presence
minimises the class-prior-corrected risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the sigmoid loss l. Where the second part falls below zero, the step
climbs back instead, so the risk cannot be driven negative by memorising.

The classifier is fitted on a bounded sample: at most POSITIVES and UNLABELLED
distinct documents, chosen by a hash of their ids and texts. The unlabelled are
drawn from all training documents, confirmed ones among them, as the risk
assumes. The prior is the share of toxic rows among the labelled ones, or
DEFAULT_PRIOR without such rows. Only FEATURES bits of each sampled document
come to the driver.

Defined results: null and empty texts get the score of a text without words;
texts are read whole, in slices of the Arrow batches; repeated rows are scored
each and sampled once; a document labelled twice is toxic if one label says so;
equal scores stay equal; without positives every score is the prior; an empty
table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as rt

POSITIVES, UNLABELLED = 4_000, 12_000
DEFAULT_PRIOR = 0.05
HASHES = 1 << 20
FEATURES = 1024
#: Least likelihood-ratio statistic of a word's presence against the classes.
LEAST_EVIDENCE = 12.0
#: Of six settings of these and of LEAST_EVIDENCE, compared on parts of the training rows; see the README.
STEPS, RATE, SHRINK = 3000, 0.05, 2e-6
#: Largest step of a weight at which the descent ends.
SETTLED = 2e-4

_WORD = re.compile(r"\w+")


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's distinct words in lower case."""
    return np.array(sorted({zlib.crc32(w.encode("utf-8", "replace")) % HASHES for w in set(_WORD.findall(text.lower()))}), np.int32)


@dataclass
class Classifier:
    weights: dict[int, float]
    bias: float

    def score(self, text: str) -> float:
        g = self.bias + sum(self.weights.get(zlib.crc32(w.encode("utf-8", "replace")) % HASHES, 0.0) for w in set(_WORD.findall(text.lower())))
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, g)))))


def _evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood-ratio statistic of counts a of n against b of m."""
    total = 0.0
    for seen, of in ((a, n), (b, m)):
        for x, y in ((seen, a + b), (of - seen, n + m - a - b)):
            with np.errstate(divide="ignore", invalid="ignore"):
                total = total + np.where(x > 0, x * np.log(x * (n + m) / (y * of)), 0.0)
    return 2 * total


def risk(w: np.ndarray, x: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk and their gradients: prior * E_pos[l(g)], and E_unl[l(-g)] - prior * E_pos[l(-g)]."""
    small = w.astype(x.dtype)
    sp, su = (1 / (1 + np.exp(-np.clip(t @ small, -50, 50))) for t in (x, u))
    # l(g) = 1 - s(g) and l(-g) = s(g); both have the slope s (1 - s).
    up, uu = (sp * (1 - sp)) @ x / len(x), (su * (1 - su)) @ u / len(u)
    return prior * float(1 - sp.mean(dtype=float)), float(su.mean(dtype=float) - prior * sp.mean(dtype=float)), -prior * up, uu - prior * up


def descend(x: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights (the last is the bias) of least non-negative risk, by Adam over all rows, until they settle."""
    w, first, second = np.zeros(x.shape[1]), 0.0, 0.0
    for turn in range(1, STEPS + 1):
        _, negative, gp, gn = risk(w, x, u, prior)
        grad = gp + gn if negative >= 0 else -gn
        grad = grad + SHRINK * np.r_[w[:-1], 0]
        first = first + 0.1 * (grad - first)
        second = second + 0.001 * (grad * grad - second)
        step = RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return w


def chosen_words(counts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Hashes of at most FEATURES words whose presence tells the classes apart most, by counts of documents of each."""
    evidence = _evidence(counts[0], sizes[0], counts[1], sizes[1])
    chosen = np.flatnonzero(evidence >= LEAST_EVIDENCE)
    return np.sort(chosen[np.argsort(-evidence[chosen], kind="stable")][:FEATURES]).astype(np.int32)


def presence(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """A row for each document: 1 where it holds the chosen word; the last column is the bias's."""
    out = np.zeros((len(rows), len(chosen) + 1), np.float32)
    out[:, -1] = 1
    for r, hashes in enumerate(rows):
        out[r, :-1] = np.isin(chosen, hashes)
    return out


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """The classifier of two lists of word hashes."""
    if not positives or not unlabelled:
        return _constant(prior)
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=HASHES) for rows in (positives, unlabelled)]
    chosen = chosen_words(counts, [len(positives), len(unlabelled)])
    return _classifier(chosen, descend(presence(positives, chosen), presence(unlabelled, chosen), prior))


def _constant(prior: float) -> Classifier:
    return Classifier({}, float(np.log(prior / (1 - prior))))


def _classifier(chosen: np.ndarray, w: np.ndarray) -> Classifier:
    return Classifier({int(h): float(v) for h, v in zip(chosen, w[:-1], strict=True)}, float(w[-1]))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        raw = [word_hashes(x or "") for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("toxic"), pa.array(raw, pa.list_(pa.int32()))], names=["toxic", "hashes"])


def some(keys: DataFrame, most: int) -> DataFrame:
    """At most `most` distinct `key`s, by their hash; about twice as many are ranked, however many there are."""
    distinct = keys.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    share = min(1.0, (2.0 * most + 200) / max(1, distinct))
    near = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(share * (1 << 32)))
    return near.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(most)


def sampled(docs: DataFrame, marked: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """`toxic` and `text` of the sample: distinct rows (doc_id, text) whose doc_id is in `marked`, and of all rows.

    The rows are chosen by keys alone; only chosen texts move.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.xxhash64("doc_id", "text").alias("key")
    keys = rt.materialise(rows.select("doc_id", key), "keys")
    chosen = some(keys.join(marked, "doc_id", "left_semi"), positives).withColumn("toxic", F.lit(1))
    chosen = rt.materialise(chosen.unionByName(some(keys, unlabelled).withColumn("toxic", F.lit(0))), "chosen")
    # At most positives + unlabelled rows of two numbers: small enough to broadcast at any input size.
    found = rows.select(key, "text").join(F.broadcast(chosen), "key")
    return found.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """The classifier of the rows (doc_id, text) and (doc_id, toxic)."""
    rt.prepare(docs.sparkSession)
    known = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = known.agg(F.sum("toxic"), F.count("toxic")).first()
    prior = min(0.5, max(1e-4, shares[0] / shares[1])) if shares[0] else DEFAULT_PRIOR
    with rt.passing():
        both = sampled(docs, known.where("toxic = 1").select("doc_id"), positives, unlabelled)
        sample = rt.materialise(both.mapInArrow(_hashed, "toxic int, hashes array<int>"), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return _constant(prior)
    # At most HASHES rows; then FEATURES bits of each sampled document.
    table = sample.select("toxic", F.explode("hashes").alias("h")).groupBy("h").agg(*[F.count_if(F.col("toxic") == t).cast("int").alias(f"n{t}") for t in (1, 0)]).toArrow()
    counts = [np.zeros(HASHES, np.int64) for _ in (1, 0)]
    for part, t in zip(counts, (1, 0), strict=True):
        part[table["h"].to_numpy()] = table[f"n{t}"].to_numpy()
    chosen = chosen_words(counts, [sizes[1], sizes[0]])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(presence([np.array(x, np.int32) for x in batch.column("hashes").to_pylist()], chosen)[:, :-1].astype(bool), axis=1)
            yield pa.record_batch([batch.column("toxic"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["toxic", "bits"])

    found = sample.mapInArrow(packed, "toxic int, bits binary").toArrow()
    toxic, bits = found["toxic"].to_pylist(), found["bits"].to_pylist()
    rt.discard(sample)

    def unpacked(t: int) -> np.ndarray:
        mine = sorted(b for b, x in zip(bits, toxic, strict=True) if x == t)
        flat = np.frombuffer(b"".join(mine), np.uint8).reshape(len(mine), -1)
        return np.c_[np.unpackbits(flat, axis=1, count=len(chosen)), np.ones(len(mine), np.uint8)].astype(np.float32)

    return _classifier(chosen, descend(unpacked(1), unpacked(0), prior))


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score of each row; only the text is looked at."""
    rt.prepare(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rt.slices(batches, "text"):
            scores = [model.score(x or "") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned without the held-out rows' labels, applied to all."""
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
