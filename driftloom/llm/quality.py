"""Quality by weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on each document. The votes of
all documents form a histogram of at most 3^rules patterns; expectation
maximisation over it estimates how often each rule is right on good and on bad
documents, and each document gets the posterior probability of being good. The
starting beliefs count as a hundredth of the documents: where a class is rarer
than that, its rates stay near these beliefs.

Defined results: null text has no words; repeated rows are judged alike; a
posterior of exactly 0.5 is kept; texts are measured whole, in slices of the Arrow
batches; an empty table gives an empty result; input columns of any name are
passed over (marking) or handed on unchanged (filtering).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import runtime as rt

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct", "n_plain", "n_echoes")


def repeat_words(words: list[bytes], distinct: dict[bytes, int]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, the first included.

    Windows get ids by doubling: ids of 2 words from ids of 1, of 4 from 2, of 8 from 4.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    ids, width = np.array([distinct[w] for w in words], np.int64), 1
    while width < WINDOW:
        pairs = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        values, ids = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The METRICS of one text, given as UTF-8."""
    words = raw.split()
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct.setdefault(w, len(distinct))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    points = sum(map(len, words)) if raw.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    ended = sum(line.rstrip()[-1:] in b".!?:;\"" for line in lines)
    plain = sum(w.rstrip(".,;:!?").isalpha() for w in raw.decode("utf-8", "replace").split())
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    return (len(words), points, len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, distinct), len(lines), ended, len(distinct), plain, echoes)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        table = np.array([measure(x) for x in rt.texts_as_bytes(batch.column("text"))], np.int64).reshape(-1, len(METRICS))
        found = pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=list(METRICS))
        yield pa.record_batch([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "metrics"])


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of each row and, last, the struct of its METRICS; written once."""
    rt.prepare(docs.sparkSession)
    given = docs.select(*[rt.quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").cast("string").alias("text"))
    struct = StructType([StructField(m, LongType()) for m in METRICS])
    schema = StructType([*given.schema.fields[:-1], StructField("metrics", struct)])
    found = rt.materialise(given.mapInArrow(_measured, schema), "metrics")
    return found.toDF(*columns, rt.free_name(docs, "__dl_metrics"))


def _of(rows: DataFrame) -> Callable[[str], Column]:
    """The metrics of `measured()` rows by name."""
    struct = rt.quoted(rows.columns[-1])
    return lambda name: struct.getField(name)


def rules(_m: Callable[[str], Column]) -> dict[str, tuple[Column, Column]]:
    """Each rule's conditions for a good and for a bad vote; it abstains where neither holds."""
    words, lines = F.greatest(_m("n_words"), F.lit(1)), F.greatest(_m("n_lines"), F.lit(1))
    mean = _m("word_chars") / words
    symbols = _m("n_symbols") / words
    repeats = _m("n_repeat_words") / words
    varied = _m("n_distinct") / words
    copied = _m("n_dup_lines") / lines
    ended = _m("n_ended") / lines
    return {
        "length": (_m("n_words") >= 50, _m("n_words") < 20),
        "word_length": (mean.between(3.0, 10.0), ~mean.between(2.0, 16.0)),
        "symbols": (symbols <= 0.05, symbols > 0.15),
        "repeated_windows": (repeats <= 0.1, repeats > 0.25),
        "distinct_words": ((_m("n_words") >= 50) & (varied >= 0.3), (_m("n_words") >= 50) & (varied < 0.12)),
        "copied_lines": ((_m("n_lines") >= 3) & (copied <= 0.1), (_m("n_dup_lines") >= 3) & (copied > 0.5)),
        "plain_words": (_m("n_plain") / words >= 0.75, _m("n_plain") / words < 0.6),
        "echoes": (_m("n_echoes") / words <= 0.05, _m("n_echoes") / words > 0.2),
        "line_ends": (ended >= 0.5, (_m("n_lines") >= 3) & (ended < 0.1)),
    }


def votes(_m: Callable[[str], Column]) -> list[Column]:
    return [F.when(good, 1).when(bad, -1).otherwise(0) for good, bad in rules(_m).values()]


@dataclass
class VoteModel:
    """Class prior and, for each rule, how often it is right on good and on bad documents."""

    prior: float
    right_on_good: np.ndarray
    right_on_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        up, down = self.weights()
        logit = np.log(self.prior / (1 - self.prior)) + (patterns > 0) @ up - (patterns < 0) @ down
        return 1 / (1 + np.exp(-logit))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds that a good vote adds and that a bad vote takes."""
        return np.log(self.right_on_good / (1 - self.right_on_bad)), np.log(self.right_on_bad / (1 - self.right_on_good))


#: Beliefs before any document is seen: few documents are bad, rules seldom
#: flag a good one, and a bad one is bad in some ways only.
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.85, 0.99, 0.5


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> VoteModel:
    """Expectation maximisation over vote patterns with their counts.

    Starts from the beliefs above, which also enter each round as pseudo
    observations worth a hundredth of the documents: rates stay inside (0, 1)
    and the two classes cannot swap.
    """
    k = patterns.shape[1]
    model = VoteModel(PRIOR, np.full(k, RIGHT_ON_GOOD), np.full(k, RIGHT_ON_BAD))
    extra = 0.01 * max(1.0, float(counts.sum()))
    up, down = patterns > 0, patterns < 0
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        bad = counts - good
        after = VoteModel(
            float((good.sum() + PRIOR * extra) / (counts.sum() + extra)),
            (good @ up + RIGHT_ON_GOOD * extra) / (good @ (up | down) + extra),
            (bad @ down + RIGHT_ON_BAD * extra) / (bad @ (up | down) + extra),
        )
        moved = abs(after.prior - model.prior) + np.abs(after.right_on_good - model.right_on_good).max() + np.abs(after.right_on_bad - model.right_on_bad).max()
        model = after
        if moved < tolerance:
            break
    return model


def learn(rows: DataFrame) -> VoteModel:
    """The model of all rows' votes; at most 3^9 patterns come to the driver."""
    found = votes(_of(rows))
    names = [f"v{i}" for i in range(len(found))]
    table = rows.select(*[v.alias(n) for v, n in zip(found, names, strict=True)]).groupBy(*names).count().collect()
    patterns = np.array([r[:-1] for r in table], np.int64).reshape(-1, len(names))
    return fit(patterns, np.array([r[-1] for r in table], float))


def posterior(model: VoteModel, _m: Callable[[str], Column]) -> Column:
    up, down = model.weights()
    logit = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for vote, a, b in zip(votes(_m), up, down, strict=True):
        logit = logit + F.when(vote == 1, float(a)).when(vote == -1, -float(b)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def base_failed(_m: Callable[[str], Column]) -> Column:
    return (_m("n_words") < 20) | (100 * _m("n_repeat_words") > 30 * _m("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: metrics, base verdict, posterior quality and `kept`."""
    rows = measured(docs, ["doc_id"])
    metric = _of(rows)
    quality = posterior(learn(rows), metric)
    return rows.select(
        "doc_id",
        *[metric(m).alias(m) for m in METRICS[:5]],
        base_failed(metric).alias("base_failed"),
        (~base_failed(metric) & (quality >= 0.5)).alias("kept"),
        quality.alias("quality"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass the base rules and are likelier good than bad."""
    rows = measured(docs, docs.columns)
    kept = ~base_failed(_of(rows)) & (posterior(learn(rows), _of(rows)) >= 0.5)
    return rows.where(kept).select(*[rt.quoted(c) for c in docs.columns])
