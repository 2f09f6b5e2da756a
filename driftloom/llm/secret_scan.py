"""Secret scans: credential patterns plus password guess costs.

Three patterns are always reported: assignments of credential names, access key
ids and long hexadecimal runs. Beyond them, values in looser credential
contexts ("password is ...", "pwd: ...", "Bearer ...") are reported as `cred`
where they would cost many guesses: dynamic programming finds the cheapest cut
of a value into words, dates, repeats, sequences, keyboard walks and brute-force
spans, in powers of ten of guesses. Words are frequent passwords and the whole
words of the public byte-pair vocabulary, by rank, so ordinary words are cheap.

Offsets are code points, ends exclusive. Defined results: null text counts as
empty and has no spans; texts are scanned whole, in slices of the Arrow batches;
spans that start together are ordered by kind; repeated rows are scanned each; an
empty table gives an empty result; other columns, of any name, are handed on
unchanged by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as rt

KINDS = ("assign", "access", "hex", "cred")
_NAMES = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "key", "pin")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|pin|(?:api|access|private|client|auth)[_\x20-]?(?:key|token|secret))["']?\x20*(?:is|was|are|:=?|=>?)\x20*["'`]?([^\s"'`<>,;]+)"""
    r"""|(?<![A-Za-z0-9])bearer\x20+([A-Za-z0-9+/_.=~-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Powers of ten of guesses from which a value in a credential context counts as a secret.
LEAST_COST = 9.0
LEAST_LENGTH = 8

# Frequent passwords and words of passwords, most frequent first.
WORDS = (
    "password qwerty letmein dragon baseball football monkey abc master shadow michael superman batman trustno "
    "hello charlie welcome admin login princess sunshine iloveyou starwars whatever freedom secret summer winter "
    "spring autumn love hunter ranger buster soccer hockey killer george andrew joshua matthew jordan jennifer "
    "thomas robert daniel ashley jessica amanda nicole hannah michelle pepper ginger cookie banana orange apple "
    "purple yellow silver golden diamond flower butterfly tigger mustang corvette ferrari mercedes porsche yankees "
    "dallas boston london paris access server system default changeme guest root user test example sample demo "
    "token key pass word data home house happy lucky magic money music ninja pirate rocket computer internet "
    "google windows linux apple samsung the and you for that with this from have not are was his her they be at "
    "one all there when your can said use each which their will other about out many then them these some would"
).split()


@functools.cache
def ranks() -> dict[str, int]:
    """Rank of each word: WORDS, then the whole words of the public vocabulary in its order, most frequent first."""
    import public_tokenizers

    words = list(WORDS)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            if len(token) > 3 and token[:1] == b" " and token[1:].isalpha():
                words.append(token[1:].decode("ascii").lower())
    out: dict[str, int] = {}
    for word in words:
        out.setdefault(word, len(out) + 1)
    return out


@functools.cache
def _longest() -> int:
    return max(map(len, ranks()))


# Rows of the common keyboard and substitutions of letters.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("430157@$!|", "aeoistasil")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")

_PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,32}?)\1+", re.DOTALL)
BRUTE = 1.0  # one more character takes ten times the guesses
SEGMENT = 0.3  # guessing how a value is cut: a factor of two for each part


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _runs(low: str) -> Iterator[tuple[int, int, float]]:
    """Maximal keyboard walks and character sequences of three and more."""
    keys = low.translate(_SHIFTED)
    for kind in ("walk", "sequence"):
        start = 0
        for i in range(1, len(low) + 1):
            if i < len(low) and kind == "walk":
                goes_on = _near(keys[i - 1], keys[i])
            elif i < len(low):
                step = ord(low[i]) - ord(low[i - 1])
                goes_on = abs(step) == 1 and (i - 1 == start or step == ord(low[i - 1]) - ord(low[i - 2]))
            else:
                goes_on = False
            if goes_on:
                continue
            if i - start >= 3:
                length = i - start
                if kind == "walk":
                    turns = 1 + sum((ord(keys[j + 1]) - ord(keys[j])) != (ord(keys[j]) - ord(keys[j - 1])) for j in range(start + 1, i - 1)) * 0.25
                    yield start, i, math.log10(47 * length) + 0.66 * turns
                else:
                    yield start, i, math.log10(26 * length)
            start = i if kind == "walk" or i - start < 2 else i - 1
            if i - start == 1 and kind == "sequence" and i < len(low) and abs(ord(low[i]) - ord(low[i - 1])) != 1:
                start = i


def _spans(value: str, deep: bool) -> Iterator[tuple[int, int, float]]:
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    rank_of, longest = ranks().get, _longest()
    for i in range(len(low)):
        for j in range(i + 3, min(len(low), i + longest) + 1):
            rank = rank_of(low[i:j])
            if rank is None and (rank := rank_of(plain[i:j])) is not None:
                rank *= 4
            if rank is None and (rank := rank_of(low[i:j][::-1])) is not None:
                rank *= 2
            if rank is not None:
                yield i, j, math.log10(rank * (2 if value[i:j] != low[i:j] else 1) + 1)
    for i in range(len(low)):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            yield i, m.end(), math.log10(365 * 20) if m.end() - i > 4 else 2.0
    yield from _runs(low)
    if deep:
        for m in _REPEAT.finditer(value):
            unit = len(m[1])
            if m.end() - m.start() >= 3:
                yield m.start(), m.end(), guess_cost(m[1], False) + math.log10((m.end() - m.start()) // unit)


def guess_cost(value: str, deep: bool = True) -> float:
    """The least power of ten of guesses over all cuts of the value into known spans and brute force."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value, deep):
        ending.setdefault(j, []).append((i, cost))
    known = [0.0] + [math.inf] * n  # cheapest cut whose last part is a known span
    brute = [math.inf] * (n + 1)  # cheapest cut whose last part is brute force
    for j in range(1, n + 1):
        brute[j] = BRUTE + min(brute[j - 1], known[j - 1] + SEGMENT)
        known[j] = min((min(known[i], brute[i]) + SEGMENT + cost for i, cost in ending.get(j, ())), default=math.inf)
    return max(0.0, min(known[n], brute[n]) - SEGMENT) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three fixed patterns."""
    found, low = [], text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def added_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Costly values in credential contexts that touch no span of the base."""
    low = text.lower()
    if not any(word in low for word in _CONTEXTS):
        return []
    taken, found, at = sorted((a, b) for a, b, _, _ in base), [], 0
    for m in _CONTEXT.finditer(text):
        group = 1 if m[1] is not None else 2
        value = m[group].rstrip(".!?:)]}")
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(a < m.end() for a, _ in taken[at : at + 1]) or len(value) < LEAST_LENGTH:
            continue
        if guess_cost(value) >= LEAST_COST:
            found.append((m.start(group), m.start(group) + len(value), "cred", value))
    return found


def find(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, str]]]:
    """Base spans and all spans of a text, in order."""
    base = base_spans(text)
    every = sorted([*base, *added_spans(text, base)], key=lambda x: (x[0], KINDS.index(x[2])))
    return base, every


def joined(spans: list[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


_SPAN = "array<struct<kind:string,start:long,end:long,cost:double>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))
    for batch in rt.slices(batches, "text"):
        every, base_joined = [], []
        for text in batch.column("text").to_pylist():
            base, spans = find(text or "")
            base_joined.append(joined(base))
            every.append([{"kind": k, "start": a, "end": b, "cost": guess_cost(v)} for a, b, k, v in spans])
        yield pa.record_batch([batch.column("doc_id"), pa.array(every, span), pa.array(base_joined, pa.string())], names=["doc_id", "found", "base"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, `found` (all spans with the guess cost of their value) and `base` (the joined base spans)."""
    rt.prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanned, f"doc_id {kind}, found {_SPAN}, base string")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cred of scanned documents."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    text = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        count("cred").alias("n_cred"),
    )


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by `[kind]`."""
    if not text:
        return text
    spans = find(text)[1]
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets of `text` masked; n_chars, where there is one, follows the new text."""
    rt.prepare(docs.sparkSession)

    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rt.slices(batches, f"c{place}"):
            texts = pa.array([masked(x) for x in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.record_batch([texts if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    plain = docs.select(*[rt.quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = plain.mapInArrow(mask, plain.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.char_length("text")).cast(kind))
    return out
