"""Encoding with a public byte-level tokenizer as a tree of joins.

Encoding is a monoid over pieces of a text once neighbours can be joined: a
text longer than a leaf is halved, the halves are encoded, and the join encodes
a window around the cut again.  The window grows until it begins and ends at a
place where the tokenizer's own splitting must break whatever stands around
(a blank between two words, or the end of letters before a mark); tokens
outside such a window provably cannot change.  Decoding concatenates the bytes
of the ids up the tree.

Defined results: null and empty texts give an empty list; every other text is
encoded whole, special tokens' strings as ordinary text; each row gives a row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where PATTERN breaks in any context.
BREAK = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=\p{N})(?=[\p{L}])")
LEAF = 4096
WINDOW = 32


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY) -> tiktoken.Encoding:
    """The vocabulary file of ``name`` as an encoding, once per worker."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _left_break(text: str, low: int, cut: int) -> int:
    """Nearest break at or left of the cut inside a growing window, else the beginning of the part."""
    width = WINDOW
    while True:
        start = max(low, cut - width)
        found = -1
        for m in BREAK.finditer(text, max(low, start - 1), min(len(text), cut + 2)):
            if low < m.start() < cut:
                found = m.start()
        if found >= 0:
            return found
        if start == low:
            return low
        width *= 2


def _right_break(text: str, cut: int, high: int) -> int:
    """Nearest break right of the cut inside a growing window, else the end of the part."""
    width = WINDOW
    while True:
        stop = min(high, cut + width)
        for m in BREAK.finditer(text, cut, min(len(text), stop + 2)):
            if cut < m.start() < high:
                return m.start()
        if stop == high:
            return high
        width *= 2


def encode_tree(text: str | None, enc: tiktoken.Encoding, leaf: int = LEAF) -> list[int]:
    """Token ids of a whole text; halves longer than ``leaf`` characters are joined as the module says."""
    if not text:
        return []

    def part(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return enc.encode_ordinary(text[low:high])
        cut = (low + high) // 2
        left, right = part(low, cut), part(cut, high)
        start, stop = _left_break(text, low, cut), _right_break(text, cut, high)
        tail = len(enc.encode_ordinary(text[start:cut])) if start > low else len(left)
        head = len(enc.encode_ordinary(text[cut:stop])) if stop < high else len(right)
        return left[: len(left) - tail] + enc.encode_ordinary(text[start:stop]) + right[head:]

    return part(0, len(text))


def decode_tree(ids: list[int], enc: tiktoken.Encoding) -> str:
    """Text of token ids: halves give bytes, which are concatenated before they become characters."""

    def part(low: int, high: int) -> bytes:
        if high - low <= LEAF:
            return enc.decode_bytes(ids[low:high])
        cut = (low + high) // 2
        return part(low, cut) + part(cut, high)

    return part(0, len(ids)).decode("utf-8")


def _in_arrow(folder: str, name: str, counts_only: bool):
    """Rows (key, ids) or (key, tokens); results go out in small batches to keep memory flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [encode_tree(t, enc) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes)], ["key", "tokens"])
                    continue
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    return run


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS
) -> DataFrame:
    """Rows (key, ids) of every row of ``df``."""
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(_in_arrow(folder, name, False), f"key {kind}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def token_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS
) -> DataFrame:
    """Rows (key, tokens): the number of tokens of each text."""
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(_in_arrow(folder, name, True), f"key {kind}, tokens long")
        .withColumnRenamed("key", key)
    )
