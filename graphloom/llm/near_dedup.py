"""MinHash near-duplicate groups by a multi-index Hamming join.

A document's signature has SYMBOLS symbols of eight bits, each made of all bits of the smallest
permuted hash of its three-word shingles; half of the symbols come from one half of the shingle's
64-bit hash, half from the other, so that even texts of one shingle agree only if that is the same.
Two signatures are near when at most RADIUS symbols
differ. The signature is split into CHUNKS chunks; with CHUNKS * (ERRORS + 1) = RADIUS + 1, a near
pair has, by the pigeonhole principle, a chunk with at most ERRORS differing symbols. Each chunk is
looked up under every choice of ERRORS symbols left out, so that all near pairs meet under some key.
The groups are the connected components of near pairs. Equal signatures are folded into one before
the join, so copies cost nothing there.

What meets under a key is joined in two steps, neither of which holds a key's members in one task.
First all of them are compared with the key's least member, found by a partial aggregate. Keys whose
members are then in one component are done, for whatever else they could link is linked. Members of
the others are spread over blocks of about TILE by hash, and each pair of blocks is a tile of its own
in which members of different components are compared in full. So no pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import UID, Words, every, fresh, mix, windows, with_uid
from graphloom.storage import cut, drop, scratch

SHINGLE = 3
SYMBOLS = 64
RADIUS = 19
CHUNKS = 10
ERRORS = 1
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_CACHED = 1 << 16
#: members of a block of a key's members; a tile has two
TILE = 2_000
#: edges, of 16 bytes, that the driver may join by itself
LOCAL_EDGES = 200_000


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in row order, the rows that have any, and where each one's begin.

    A row of fewer words than width has one shingle of all its words; a row without letters or
    digits has one for each run of other signs; a row of nothing but white space has none.
    """
    words = Words(column, letters_only=True)
    hashes, count = words.hashes(), words.count
    h = windows(hashes, width)
    n = np.maximum(count - width + 1, 0)
    keep = np.repeat(words.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    parts, rows = [h[keep]] if len(keep) else [], [np.repeat(np.arange(len(n)), n)]
    for row in np.flatnonzero(n == 0):
        own = hashes[words.first[row] : words.first[row + 1]]
        if not len(own):
            raw = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes()
            other = Words(pa.array([raw.decode("utf-8", "replace")]))
            own = other.hashes() ^ np.uint64(0x5851F42D4C957F2D)
            if not len(own):
                continue
        else:
            own = windows(own, len(own))
        parts.append(own)
        rows.append(np.full(len(own), row))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_h, all_rows = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(all_rows, kind="stable")
        all_h, all_rows = all_h[order], all_rows[order]
    begin = np.flatnonzero(np.r_[True, all_rows[1:] != all_rows[:-1]])
    return all_h, all_rows[begin], begin


def symbols(least: np.ndarray) -> np.ndarray:
    """Eight bits of each 32-bit value, all bits of which have a part in them."""
    x = least ^ (least >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return (x >> np.uint32(24)).astype(np.uint8)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles and their signatures, uint8 (rows, SYMBOLS)."""
    h, rows, begin = shingles(column)
    out = np.empty((len(rows), SYMBOLS), np.uint8)
    halves = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
    ends = np.r_[begin[1:], len(h)]
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + _CACHED, "right")))
        lo, hi = begin[i], ends[j - 1]
        best = np.full((j - i, SYMBOLS), 0xFFFFFFFF, np.uint32)
        for at in range(lo, hi, _CACHED * 4):  # one very long row goes in pieces
            parts = [x[at : min(hi, at + _CACHED * 4)] for x in halves]
            cuts = begin[i:j] - at if hi - lo <= _CACHED * 4 else np.zeros(1, np.int64)
            for k in range(SYMBOLS):
                np.minimum(best[:, k], np.minimum.reduceat(parts[2 * k // SYMBOLS] * _A[k] + _B[k], cuts), out=best[:, k])
        out[i:j] = symbols(best)
        i = j
    return rows, out


def masks(symbols: int = SYMBOLS, chunks: int = CHUNKS, errors: int = ERRORS) -> list[np.ndarray]:
    """Positions looked at by each key: every chunk without every choice of errors symbols."""
    edges = np.linspace(0, symbols, chunks + 1).round().astype(int)
    return [np.array([p for p in range(a, b) if p not in out]) for a, b in zip(edges[:-1], edges[1:]) for out in combinations(range(a, b), min(errors, b - a))]


def keys(sig: np.ndarray) -> np.ndarray:
    """Lookup keys, uint64 (rows, number of masks)."""
    out = []
    for k, positions in enumerate(masks()):
        h = np.full(len(sig), k + 1, np.uint64)
        for p in positions:
            h = h * np.uint64(0x100000001B3) + sig[:, p] + np.uint64(1)
        out.append(mix(h))
    return np.stack(out, 1) if len(sig) else np.zeros((0, len(masks())), np.uint64)


def near_links(sig: np.ndarray, component: np.ndarray, radius: int = RADIUS) -> set[tuple[int, int]]:
    """Pairs of components that near pairs link, enough of them that what near pairs connect is
    connected. Each member looks only at those not yet reached, so that a dense group takes one
    comparison a member."""
    columns, left, alive, links = np.ascontiguousarray(sig.T), np.arange(len(sig)), np.ones(len(sig), bool), set()
    while alive.any():
        if 2 * alive.sum() < len(left):
            columns, left, alive = np.ascontiguousarray(columns[:, alive]), left[alive], np.ones(int(alive.sum()), bool)
        own = alive & (component[left] == component[left[int(np.argmax(alive))]])
        alive &= ~own
        queue = left[own].tolist()
        while queue and alive.any():
            x = queue.pop()
            near = ((columns != sig[x][:, None]).view(np.uint8).sum(0, dtype=np.uint8) <= radius) & alive
            if near.any():
                met = np.unique(component[left[near]])
                links |= {(int(component[x]), int(c)) for c in met}
                reached = alive & np.isin(component[left], met)
                queue += left[reached].tolist()
                alive &= ~reached
    return links


def _joined(edges: pa.Table) -> pa.Table:
    """components() of edges in memory."""
    a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent is never greater than its child
        parent[x] = parent[parent[x]]
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[np.array(parent, np.int64)], pa.int64())})


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of each node of the undirected edges (a, b); root is the component's smallest
    node. Up to local edges are joined by the driver; for more, large-star and small-star alternate,
    each round a written table in the shared folder."""
    spark = edges.sparkSession

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.where("b > a") if large else both
        out = linked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "stars"))
        df.write.parquet(paths[-1])
        for old in paths[:-1]:
            drop(spark, old)
        del paths[:-1]
        return spark.read.parquet(paths[-1])

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, after = None, mark(now)
    if after[0] <= local:
        return cut(spark.createDataFrame(_joined(now.toArrow()), "node long, root long"), "components")
    while before != after:
        now = written(stars(stars(now, True), False))
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, sig = signatures(part.column(2))
                own = part.take(pa.array(rows))
                flat = pa.Array.from_buffers(pa.binary(SYMBOLS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())])
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), flat.cast(pa.binary())], [UID, "doc_id", "sig"])

    return docs.select(UID, F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(run, f"{UID} long, doc_id long, sig binary")


def _keyed(folded: DataFrame) -> DataFrame:
    """(key, node): the lookup keys of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                k = keys(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), k.shape[1]))], ["key", "node"])

    return folded.select("node", "sig").mapInArrow(run, "key long, node long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) within the radius, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1) <= RADIUS
                yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _tiled(rest: DataFrame, tile: int) -> DataFrame:
    """(a, b): links between components of the members (key, node, component, sig) of the keys, all
    pairs of a key's members being compared within tiles of two of its blocks."""
    size = rest.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = rest.join(size, "key").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "component", "sig")
    # tiles travel together, some 20,000 rows in a group, so that small ones cost little each
    rows = size.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    groups = max(1, int(rows) // 20_000)

    def verify(group: pa.Table) -> pa.Table:
        key, low, high, component = (group.column(c).to_numpy() for c in ("key", "low", "high", "component"))
        order = np.lexsort((group.column("node").to_numpy(), high, low, key))
        key, low, high, component, sig = key[order], low[order], high[order], component[order], _matrix(group.column("sig"))[order]
        begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        links: set[tuple[int, int]] = set()
        for i, j in zip(begin.tolist(), np.r_[begin[1:], len(key)].tolist()):
            links |= near_links(sig[i:j], component[i:j])
        both = np.array(sorted(links), np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return spread.withColumn("group", F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups))).groupBy("group").applyInArrow(verify, "a long, b long").distinct()


def _roots(folded: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, root) of the nodes that have a near one; folded has (node, sig)."""
    entries = _keyed(folded)
    least = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    met = cut(entries.join(least, "key"), "met")
    sig_a, sig_b = folded.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), folded.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    first = components(_near(met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct().join(sig_b, "b").join(sig_a, "a")))
    placed = met.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = cut(placed.join(open_keys, "key").join(folded.select("node", "sig"), "node"), "open")
    if rest.isEmpty():
        return first
    second = components(_tiled(rest, tile)).select(F.col("node").alias("component"), F.col("root").alias("whole"))
    # nodes that only the second step links are components of their own after the first
    alone = second.join(first.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("component").alias("root"))
    return first.unionByName(alone).withColumnRenamed("root", "component").join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("root"))


def near_groups(keyed: DataFrame) -> DataFrame:
    """(row key, doc_id, kept key, kept doc_id) of each row that has a near or exact copy, the one
    that stays included: the smallest doc_id of the group, null ones last, then the first row."""
    signed = cut(_signed(keyed), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(UID).alias("key"))
    folded = cut(signed.groupBy("sig").agg(F.min(UID).alias("node"), F.min(place).alias("best"), F.count("*").alias("size")), "folded")
    rooted = folded.join(_roots(folded), "node", "left").select("sig", "best", "size", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"), F.sum("size").alias("size")).where("size > 1")
    kept = rooted.select("sig", "root").join(best, "root").select("sig", "best")
    return signed.join(kept, "sig").select(UID, "doc_id", F.col("best.key").alias("kept_key"), F.col("best.doc_id").alias("kept_doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): each row that a group of near copies can spare, and the one it keeps.

    Groups are the connected components of near signatures, links between different texts and copies
    alike; of n copies, n - 1 are reported. Null texts and texts of nothing but white space belong to
    no group; short texts are in one if they have the same words, or, without words, the same signs.
    Repeated rows are copies of each other; of equal doc_ids the first row stays. Null doc_ids stay
    null and are kept last. An empty table gives no rows. Whole texts are hashed; other columns are
    not read, whatever their names.
    """
    keyed = with_uid(docs.select("doc_id", "text"))
    return near_groups(keyed).where(F.col(UID) != F.col("kept_key")).select("doc_id", F.col("kept_doc_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, without those that near_duplicates() reports.

    So rows with null or blank texts all stay, and of repeated rows one. An empty table stays empty.
    """
    key = fresh(docs.columns)
    keyed = with_uid(docs, key)
    spare = near_groups(keyed.select(F.col(key).alias(UID), "doc_id", "text")).where(F.col(UID) != F.col("kept_key")).select(F.col(UID).alias(key))
    return keyed.join(spare, key, "left_anti").select(*every(docs.columns))
