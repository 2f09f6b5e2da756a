"""Byte-level BPE: encoding with offsets and decoding, over Arrow batches.

The tokenizers library encodes; its vocabulary is rebuilt from a rank file, in
which a token's merge is the last step that makes its bytes from two tokens of
lower rank. Tokens are spelt in the byte alphabet, one printable character for
each byte. Decoding reverses that table, joins the bytes and only then reads
UTF-8, so characters cut across tokens come back whole.

Defined results: null text counts as empty and has no tokens; strings of special
tokens are ordinary text; texts are encoded whole; repeated rows are encoded
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as rt


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(0x100 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_of(token: bytes, rank: int, by: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge gives `token`: what is left after all merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: by.get(parts[i] + parts[i + 1], rank))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file; each match of the pattern is encoded alone."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    by, table = ranks(path), byte_alphabet()
    spelt = lambda raw: "".join(map(table.__getitem__, raw))
    merges = [tuple(map(spelt, merge_of(t, r, by))) for t, r in sorted(by.items(), key=lambda x: x[1]) if len(t) > 1]
    # The library's word cache costs more than it saves on texts with many rare words.
    made = Tokenizer(models.BPE(vocab={spelt(t): r for t, r in by.items()}, merges=merges, cache_capacity=0))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, read back from the spelling in the byte alphabet."""
    table = byte_alphabet()
    back = {c: b for b, c in table.items()}
    spelt = {r: "".join(map(table.__getitem__, t)) for t, r in ranks(path).items()}
    return [bytes(map(back.__getitem__, spelt.get(i, ""))) for i in range(max(spelt) + 1)]


def decode(ids: Iterable[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode_stream(ids: Iterable[int], table: list[bytes]) -> Iterator[str]:
    """Text as tokens arrive; bytes of an unfinished character wait for the next token."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield reader.decode(table[i])
    yield reader.decode(b"", final=True)


def byte_offsets(ids: list[int], table: list[bytes]) -> tuple[list[int], list[int]]:
    """Start and end of each token in the text's bytes."""
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64).tolist()
    return [0, *ends[:-1]] if ends else [], ends


def char_offsets(raw: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Code points that each token touches; a character cut across tokens belongs to all of them."""
    leads = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    number = np.concatenate([[0], np.cumsum(leads)])
    first = number[np.minimum(np.array(starts, np.int64) + 1, len(raw))] - 1
    return first.tolist(), number[np.array(ends, np.int64)].tolist()


def encoded(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids and, for each token, its start and end in bytes and in code points."""
    rt.prepare(docs.sparkSession)
    parts = ("byte_start", "byte_end", "char_start", "char_end") if offsets else ()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = tokenizer(path, pattern), token_bytes(path)
        for batch in rt.slices(batches, "text", 1 << 20):
            raws = rt.texts_as_bytes(batch.column("text"))
            ids = [x.ids for x in made.encode_batch_fast([x.decode() for x in raws], add_special_tokens=False)]
            columns: list[list[list[int]]] = [[] for _ in parts]
            for raw, one in zip(raws, ids, strict=True) if offsets else ():
                starts, ends = byte_offsets(one, table)
                for column, value in zip(columns, (starts, ends, *char_offsets(raw, starts, ends)), strict=True):
                    column.append(value)
            lists = pa.list_(pa.int32())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, lists) for x in (ids, *columns))], names=["doc_id", "ids", *parts])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, ", ".join([f"doc_id {kind}", "ids array<int>", *(f"{p} array<int>" for p in parts)]))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and `raw`, the bytes of the ids."""
    rt.prepare(tokens.sparkSession)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [decode(x or (), table) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(back, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding, then decoding, of each text in one pass."""
    rt.prepare(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = tokenizer(path, pattern), token_bytes(path)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in rt.slices(batches, "text", 1 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sizes, id_sums, text_sums = [], [], []
            for one in made.encode_batch_fast(texts, add_special_tokens=False):
                ids = one.ids
                sizes.append(len(ids))
                id_sums.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(decode(ids, table)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
