"""Shared pieces of the training-data operators: stable row keys and vectorised word windows.

Word windows work on the raw UTF-8 buffers of Arrow string columns, so no Python string is made
for the bulk of the text. All hashes are computed modulo 2**64 and finished with a bit mixer.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut

UID = "__gl_uid"
SEGMENT = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RW = np.uint64(0xD6E8FEB86659FD93 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str = UID) -> str:
    """name, with as many underscores behind it as make it no column's name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(columns: list[str]) -> list[F.Column]:
    """The columns of these names, whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(df: DataFrame, last: F.Column) -> DataFrame:
    """df with columns c0, c1 and so on, and last behind them: what is mapped in Arrow batches then has
    no names that clash or can't be resolved. toDF(*df.columns) gives the names back."""
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(every(df.columns))], last.alias("last"))


def _scan(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files, or projections and filters of one."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def _plain(path: str) -> str:
    """The path with one slash behind its scheme: Spark writes file:/x here and file:///x there."""
    return re.sub("^([^:/]+):/+", r"\1:/", path)


def path_hash(path: str, seed: int) -> int:
    """What xxhash64(seed, path) is to Spark, without its sign."""
    inner = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    return xxhash.xxh64(_plain(path).encode(), seed=inner).intdigest()


def file_bits(files: list[str]) -> tuple[int, int]:
    """(bits, seed): the top bits of the files' seeded hashes differ between any two of them."""
    bits = max(0, len(files) - 1).bit_length()
    while True:
        for seed in range(20):
            if not bits or len({path_hash(f, seed) >> (64 - bits) for f in files}) == len(files):
                return bits, seed
        bits += 1


def with_uid(df: DataFrame, name: str = UID) -> DataFrame:
    """Adds a key of the physical row, so that repeated and null doc_ids stay separate rows.

    Rows of Parquet files are keyed by file and place in it, so the key is the same whenever and
    however the files are read: the number of executors, lost ones and the size of splits don't
    matter. Anything else is written once with its keys to the shared folder, and read from there.
    Keys order rows by file, in some fixed order of the files, and then by place.
    """
    if not _scan(df):
        return cut(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    meta = df.metadataColumn("_metadata")
    bits, seed = file_bits(sorted(set(df.inputFiles())))
    if not bits:
        return df.withColumn(name, meta["row_index"])
    path = F.regexp_replace(meta["file_path"], "^([^:/]+):/+", "$1:/")
    room = 63 - bits
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(seed), path), 64 - bits), room).bitwiseOR(meta["row_index"])
    return df.withColumn(name, F.when(meta["row_index"] < F.lit(1 << room), key).otherwise(F.raise_error(F.lit("a file has too many rows for its key"))))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes for scans, no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 1) -> int:
    """A power of two, at most 2**24, that grows with the input, so that each bucket stays of one
    size. Where the size isn't known, as of local rows, the session's shuffle partitions decide."""
    size = input_bytes(df)
    want = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 60 else size // bytes_each
    return 1 << min(24, max(0, int(max(least, want) - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """r**i and r**-i modulo 2**64 for i below a size that grows on demand."""

    def __init__(self, base: np.uint64):
        self.base = base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, SEGMENT + 4096)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.multiply.accumulate(np.full(self.size, self.base, np.uint64))])
            self.down = np.concatenate([one, np.multiply.accumulate(np.full(self.size, self.inverse, np.uint64))])
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = _Powers(_R), _Powers(_RW)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length rows + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[:33] = True
_NONWORD = np.ones(256, bool)
_NONWORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Words:
    """Word starts, ends, rows and hashes of a batch of texts.

    first[row] is the index of a row's first word; first has one entry more than there are rows.
    """

    def __init__(self, column: pa.Array, letters_only: bool = False):
        self.data, self.offsets = buffers(column)
        gap = (_NONWORD if letters_only else _SPACE)[self.data]
        starts_row = np.zeros(len(self.data) + 1, bool)
        starts_row[self.offsets] = True
        inside = ~gap
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | starts_row[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | starts_row[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def _segments(self):
        """Ranges of words that lie in about SEGMENT bytes; a longer word makes a longer range."""
        i, n = 0, len(self.start)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT, "right")))
            yield i, j
            i = j

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, of its bytes."""
        out = np.empty(len(self.start), np.uint64)
        for i, j in self._segments():
            lo, hi = self.start[i], self.end[j - 1]
            up, down = BYTE_POWERS.upto(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
        return out

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of at least size bytes, and hashes of their first size bytes."""
        which = np.flatnonzero(self.end - self.start >= size)
        out = np.zeros(len(which), np.uint64)
        at = self.start[which]
        for k in range(size):
            out = out * np.uint64(0x100000001B3) + self.data[at + k] + np.uint64(1)
        return which, mix(out)


def prefix_hash(word: bytes) -> int:
    out = np.zeros(1, np.uint64)
    for c in word:
        out = out * np.uint64(0x100000001B3) + np.uint64(c + 1)
    return int(mix(out)[0])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width neighbouring words: len(hashes) - width + 1 values, row borders
    not minded. Computed in segments, so that the powers' table stays small."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = SEGMENT
    for i in range(0, n, step):
        j = min(n, i + step)
        up, down = WORD_POWERS.upto(j - i + width)
        part = hashes[i : j + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i:j] = mix((sums[width : width + j - i] - sums[: j - i]) * down[: j - i])
    return out


def row_windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one row, and the index of each window's first word."""
    h = windows(words.hashes(), width)
    if not len(h):
        return h, np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.count)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + width <= last)
    return h[at], at
