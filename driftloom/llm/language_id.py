"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language; affix, character n-gram and
lexicon features give the emissions, and learned transitions let code-switched
text change language. Forward-backward gives each word's label distribution;
their mean is the document's language distribution.

The field is fitted on a bounded sample of labelled rows: PER_LANGUAGE distinct
documents of each language, WINDOWS runs of WINDOW words spread over each.
Training sequences join runs of several languages, as code-switched text does.

Defined results: `und` with score 0 for null texts and texts without a letter;
texts are labelled whole, in slices of the Arrow batches; of equally likely
languages the first by name is taken; repeated rows are labelled each and sampled
once; without labelled rows every text is `und`; an empty table gives an empty
result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime as rt

PER_LANGUAGE = 400
WINDOWS = 8
WINDOW = 12
SWITCHES = 3  # runs of one language in a training sequence
BUCKETS = 1 << 15
EPOCHS = 6
BATCH = 128
#: Words whose emissions a worker remembers at most.
REMEMBERED = 500_000
#: Messages are scaled to sum 1 at every so many words.
SCALED = 4
#: Cells of a padded batch of sequences.
CELLS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; runs that hold no letter (other numerals) do not count."""
    found = _WORD.findall(text.lower())
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


#: Buckets of feature names met before; cleared when full.
_buckets: dict[str, int] = {}


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hash buckets of a word's affixes, n-grams and lexicon entry."""
    edged = f"<{word}>"
    n = len(edged)
    names = ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "s" + word[-4:]]
    names += [edged[i : i + 3] for i in range(n - 2)]
    names += [f"l{lexicon[word]}", "w" + word] if word in lexicon else ["l-"]
    if len(_buckets) > REMEMBERED:
        _buckets.clear()
    return [_buckets.get(x) or _buckets.setdefault(x, zlib.crc32(x.encode()) % BUCKETS) for x in set(names)]


@dataclass
class Field:
    """Languages, lexicon (word: its usual language), feature weights, transition and start scores."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    memory: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """One row a word; rows of words met before come from a table of bounded size."""
        if self.table is None:
            self.table = np.zeros((REMEMBERED, len(self.languages)), np.float32)
        at = [self.memory.get(w, -1) for w in words]
        if -1 not in at:
            return self.table[at]
        new = list({w for w, i in zip(words, at, strict=True) if i < 0})
        lists = [features(w, self.lexicon) for w in new]
        starts = np.cumsum([0, *map(len, lists[:-1])])
        fresh = dict(zip(new, np.add.reduceat(self.weights[list(chain.from_iterable(lists))], starts), strict=True))
        out = self.table[at]
        for i, w in enumerate(words):
            if at[i] < 0:
                out[i] = fresh[w]
        if len(self.memory) + len(fresh) > REMEMBERED:
            self.memory.clear()
        for w, row in fresh.items():
            if len(self.memory) < REMEMBERED:
                self.table[len(self.memory)] = row
                self.memory[w] = len(self.memory)
        return out

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "table": None}


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label distributions of padded sequences (batch, time, label) by forward-backward.

    Also the scaled emissions and backward messages that expected transitions need.
    """
    b, t, n = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    step, shortest = np.exp(transitions), int(lengths.min())
    forward, backward = np.empty_like(e), np.empty_like(e)
    a = np.exp(start) * e[:, 0]
    forward[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (forward[:, i - 1] @ step) * e[:, i]
        forward[:, i] = a / a.sum(axis=1, keepdims=True) if i % SCALED == 0 else a
    backward[:, t - 1] = 1.0 / n
    for i in range(t - 2, -1, -1):
        a = (backward[:, i + 1] * e[:, i + 1]) @ step.T
        if i % SCALED == 0:
            a /= a.sum(axis=1, keepdims=True)
        if i + 1 >= shortest:
            a[lengths <= i + 1] = 1.0 / n
        backward[:, i] = a
    both = forward * backward
    return both / both.sum(axis=2, keepdims=True), forward, backward * e


def fit(samples: dict[str, list[list[str]]], seed: int = 7) -> Field | None:
    """Field from runs of words by language: Adam on the conditional log-likelihood."""
    languages = sorted(x for x, runs in samples.items() if any(runs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    seen: dict[str, Counter] = defaultdict(Counter)
    for i, name in enumerate(languages):
        for run in samples[name]:
            for w in run:
                seen[w][i] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if c.total() >= 3 and c.most_common(1)[0][1] >= 0.8 * c.total()}
    runs = [(i, run[at : at + WINDOW]) for i, name in enumerate(languages) for run in samples[name] for at in range(0, len(run), WINDOW)]
    ids = {w: k for k, w in enumerate(seen)}
    buckets = [features(w, lexicon) for w in seen]
    spans = np.cumsum([0, *map(len, buckets)])
    flat = np.array([f for x in buckets for f in x], np.int64)
    n = len(languages)
    parts = [np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    turn = 0
    for _ in range(EPOCHS):
        # Half of the sequences switch language, half stay in one.
        order = rng.permutation(len(runs))
        by = np.array([runs[i][0] for i in order])
        mixed, whole = order[: len(order) // 2], order[len(order) // 2 :][np.argsort(by[len(order) // 2 :], kind="stable")]
        sequences = [[runs[i] for i in part[at : at + SWITCHES]] for part in (mixed, whole) for at in range(0, len(part), SWITCHES)]
        shuffled = rng.permutation(len(sequences))
        for at in range(0, len(shuffled), BATCH):
            chosen = [sequences[i] for i in shuffled[at : at + BATCH]]
            words = [[ids[w] for _, run in s for w in run] for s in chosen]
            labels = [[i for i, run in s for _ in run] for s in chosen]
            lengths = np.array(list(map(len, words)))
            t = int(lengths.max())
            grid, gold = np.zeros((len(chosen), t), np.int64), np.zeros((len(chosen), t), np.int64)
            for r, (w, y) in enumerate(zip(words, labels, strict=True)):
                grid[r, : len(w)], gold[r, : len(y)] = w, y
            real = np.arange(t) < lengths[:, None]
            used, where = np.unique(grid[real], return_inverse=True)
            table = np.stack([parts[0][flat[spans[u] : spans[u + 1]]].sum(axis=0) for u in used])
            emissions = np.zeros((len(chosen), t, n))
            emissions[real] = table[where]
            prob, forward, after = marginals(emissions, lengths, parts[1], parts[2])
            error = prob.copy()
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) - 1, 2)
            by_word = np.zeros((len(used), n))
            np.add.at(by_word, where, error[real])
            grads = [np.zeros_like(p) for p in parts]
            for k, u in enumerate(used):
                np.add.at(grads[0], flat[spans[u] : spans[u + 1]], by_word[k])
            pair = forward[:, :-1, :, None] * np.exp(parts[1]) * after[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            grads[1] = pair[real[:, 1:]].sum(axis=0)
            np.subtract.at(grads[1], (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
            grads[2] = error[:, 0].sum(axis=0)
            turn += 1
            for p, g, f1, f2 in zip(parts, grads, first, second, strict=True):
                g = g / len(chosen) + 1e-4 * p
                f1 += 0.1 * (g - f1)
                f2 += 0.001 * (g * g - f2)
                p -= 0.05 * (f1 / (1 - 0.9**turn)) / (np.sqrt(f2 / (1 - 0.999**turn)) + 1e-8)
    return Field(languages, lexicon, parts[0].astype(np.float32), parts[1], parts[2])


def label_texts(model: Field, texts: list[str | None]) -> list[np.ndarray | None]:
    """Mean label distribution of each text's words; None where it has no letter."""
    bags = [words_of(x or "") for x in texts]
    out: list[np.ndarray | None] = [None] * len(texts)
    order = sorted((i for i in range(len(texts)) if bags[i]), key=lambda i: len(bags[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(bags[order[end]]) <= CELLS:
            end += 1
        chosen = order[at:end]
        lengths = np.array([len(bags[i]) for i in chosen])
        emissions = np.zeros((len(chosen), int(lengths.max()), len(model.languages)), np.float32)
        emissions[np.arange(emissions.shape[1]) < lengths[:, None]] = model.emissions(list(chain.from_iterable(bags[i] for i in chosen)))
        prob = marginals(emissions, lengths, model.transitions.astype(np.float32), model.start.astype(np.float32))[0]
        prob[np.arange(emissions.shape[1]) >= lengths[:, None]] = 0
        for r, i in enumerate(chosen):
            out[i] = prob[r].sum(axis=0) / lengths[r]
        at = end
    return out


def label_words(model: Field, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its likeliest language."""
    words = words_of(text)
    if not words:
        return []
    emissions = model.emissions(words)[None]
    best = marginals(emissions, np.array([len(words)]), model.transitions, model.start)[0][0].argmax(axis=1)
    return [(w, model.languages[i]) for w, i in zip(words, best, strict=True)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.slices(batches, "text"):
        runs = []
        for text in batch.column("text").to_pylist():
            words = words_of(text or "")
            step = max(WINDOW, len(words) // WINDOWS)
            runs.append([w for at in range(0, len(words), step)[:WINDOWS] for w in words[at : at + WINDOW]])
        yield pa.record_batch([batch.column("lang"), pa.array(runs, pa.list_(pa.string()))], names=["lang", "words"])


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field | None:
    """Field from the rows of `docs` (doc_id, text, lang); at most per_language rows of each language."""
    rt.prepare(docs.sparkSession)
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    keyed = named.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()
    if not sizes:
        return None
    # About twice the rows wanted pass the share, whatever the size of a language; copies of a row fold before they move.
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 32, int((2.0 * per_language + 200) / r["n"] * (1 << 32))))])
    near = keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < F.element_at(shares, F.col("lang")))
    near = near.groupBy("lang", "key").agg(F.min("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    sampled = near.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")
    samples: dict[str, list[list[str]]] = defaultdict(list)
    for lang, words in sorted(map(tuple, sampled.mapInArrow(_runs, "lang string, words array<string>").collect())):
        samples[lang].append(words)
    return fit(samples)


def predict(docs: DataFrame, model: Field | None) -> DataFrame:
    """doc_id, lang_pred and score of each row; only the text is looked at."""
    rt.prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in rt.slices(batches, "text"):
            found = label_texts(known, batch.column("text").to_pylist())
            names = ["und" if p is None else known.languages[int(p.argmax())] for p in found]
            scores = [0.0 if p is None else min(1.0, float(p.max())) for p in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows that are not held out, applied to all."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
