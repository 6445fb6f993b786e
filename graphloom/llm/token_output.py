"""Token-id output as directly addressable codes.

Each id is cut into chunks of eight bits. Level 0 holds the low chunk of every id; level k + 1 holds
the next chunk of those ids of level k whose continuation bit is set. Each level but the last has
its continuation bitmap and a rank directory with the number of set bits before each 512-bit block,
so id i is read by one byte and one rank for each level, with no other id decoded.

Layout (little-endian): u32 count, u8 levels, then for each level: u32 size, size bytes, and for all
but the last level ceil(size / 8) bitmap bytes and ceil(size / 512) u32 ranks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.tokenizer import VOCABULARY, tokenizer

BLOCK = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint32)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("code", T.BinaryType())])


def encode(ids: np.ndarray) -> bytes:
    """The code of a sequence of unsigned 32-bit ids; an empty sequence has zero levels."""
    rest = np.asarray(ids, np.uint32)
    parts, levels = [], 0
    while len(rest):
        levels += 1
        parts += [struct.pack("<I", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes()]
        more = rest > 255
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        sums = np.cumsum(_POPCOUNT[padded].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32), dtype=np.uint32)
        ranks = np.zeros(len(sums), np.uint32)
        ranks[1:] = sums[:-1]
        parts += [bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint32(8)
    return struct.pack("<IB", len(ids), levels) + b"".join(parts)


def _levels(code: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """(size, offset of bytes, offset of bitmap, last) of each level."""
    count, levels = struct.unpack_from("<IB", code)
    at = 5
    for k in range(levels):
        (size,) = struct.unpack_from("<I", code, at)
        data = at + 4
        bitmap = data + size
        last = k == levels - 1
        yield size, data, bitmap, last
        at = bitmap + (0 if last else -(-size // 8) + 4 * -(-size // BLOCK))


def size(code: bytes) -> int:
    return struct.unpack_from("<I", code)[0]


def get(code: bytes, i: int) -> int:
    """Id i of the sequence, by rank only."""
    if not 0 <= i < size(code):
        raise IndexError(i)
    value = shift = 0
    for n, data, bitmap, last in _levels(code):
        value |= code[data + i] << shift
        if last or not code[bitmap + i // 8] >> (i % 8) & 1:
            return value
        block = i // BLOCK
        (rank,) = struct.unpack_from("<I", code, bitmap + -(-n // 8) + 4 * block)
        before = code[bitmap + block * (BLOCK // 8) : bitmap + i // 8]
        rank += int.from_bytes(before, "little").bit_count() + (code[bitmap + i // 8] & ((1 << i % 8) - 1)).bit_count()
        i, shift = rank, shift + 8
    raise ValueError("the code is damaged")


def decode(code: bytes) -> np.ndarray:
    """The whole sequence."""
    out = np.zeros(size(code), np.uint32)
    where = np.arange(len(out))
    for k, (n, data, bitmap, last) in enumerate(_levels(code)):
        out[where] |= np.frombuffer(code, np.uint8, n, data).astype(np.uint32) << np.uint32(8 * k)
        if not last:
            bits = np.unpackbits(np.frombuffer(code, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little")
            where = where[bits.astype(bool)]
    return out


def token_output(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, code) for each row of docs.

    Null and empty texts give zero tokens and a code of no levels. Rows stay one to one: repeated
    and null doc_ids give as many rows as they have. An empty table gives no rows. Other columns
    are not read. Very long texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.ids(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(encode, ids), pa.binary())], ["doc_id", "n_tokens", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def token_at(code: str, index: str) -> F.Column:
    """Column expression: the id at a position of a code column; null when out of range or null."""

    @F.pandas_udf("long")
    def at(codes, positions):
        import pandas as pd

        return pd.Series([int(get(c, int(i))) if c is not None and i == i and i is not None and 0 <= i < size(c) else None for c, i in zip(codes, positions)], dtype="Int64")

    return at(F.col(code), F.col(index))
