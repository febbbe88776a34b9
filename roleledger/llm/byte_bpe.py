"""Byte-level BPE by the tiktoken library, from a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

# Longer texts are encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 16
# A match of the pattern ends before a single space between two word characters and the next one starts at it.
SAFE = re.compile(r"(?<=\w) (?=\w)")
MAX_RANK_BYTES = 64 << 20


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text where no match of the pattern can cross; a text without such a place stays whole."""
    start = 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(coder: tiktoken.Encoding, text: str | None) -> list[int]:
    text = text or ""
    if len(text) <= PIECE_CHARS:
        return coder.encode_ordinary(text)
    return [token for piece in pieces(text) for token in coder.encode_ordinary(piece)]


def _ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        ranks = file.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return ranks


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", target: str = "ids") -> DataFrame:
    """Add the column ``target`` (array of int): the token ids of ``text``; none for null and empty texts.

    Special tokens are ordinary text. The rank file is read by the driver and sent to the executors; its
    size is checked. A column already called ``target`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(_ranks(rank_file))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        coder = encoding(held.value, pattern)
        return texts.map(lambda value: encode(coder, value))

    return docs.withColumn(target, ids(F.coalesce(F.col(text), F.lit(""))))


def bpe_decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", target: str = "bytes") -> DataFrame:
    """Add the column ``target`` (binary): the bytes of the token ids; empty for null and empty lists."""
    held = docs.sparkSession.sparkContext.broadcast(_ranks(rank_file))

    @F.pandas_udf("binary")
    def decoded(lists: pd.Series) -> pd.Series:
        coder = encoding(held.value, pattern)
        return lists.map(lambda value: coder.decode_bytes([] if value is None else [int(i) for i in value]))

    return docs.withColumn(target, decoded(F.col(ids)))


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for every row: one pass, no ids leave the task.

    Null texts count as empty; repeated rows give a row each.
    """
    held = docs.sparkSession.sparkContext.broadcast(_ranks(rank_file))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(held.value, pattern)
        digits = [str(i) for i in range(coder.n_vocab)]
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(coder, text)
                counts.append(len(ids))
                listed.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                names,
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
