"""Exact repeated passages across documents, by classes of equal windows of the least reported length.

Every run of LEAST words of every row is a window. Windows of equal words are one class, and stand
for each other by the first of them: the class's first place is the representative, and every other
window is a member, linked to it. A passage of at least LEAST words that two rows share is a run of
windows of shared classes, wherever it lies, so no such passage is lost, and no pairs are listed
within a class. Runs of windows that are linked to consecutive places of one row are put together,
and extended over the classes of both rows to maximal exact repeats.

The method named for this operator, anchors on non-overlapping blocks, is not used: rows would meet
by blocks shorter than LEAST, and with one partner for each block a passage that stands behind
shorter boilerplate is lost, while with all partners a block of n rows takes n squared pairs.

No task holds what may grow without bound. Within a batch all windows of a class are linked to the
batch's first one, and only that is shuffled, so a class has one entry for each batch, however many
rows hold it. The links between batches then come back to the rows by their keys.

Windows are compared by seven bytes of one 64-bit hash within a bucket chosen by another hash; the
number of buckets grows with the input. Two different windows are taken for equal with odds of about
one in a thousand for all of 100 million windows together, of 700 cases in the 2 * 10**13 of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import UID, Words, buckets_for, mix, windows, with_uid
from graphloom.storage import cut

LEAST = 50
KEY_BYTES = 7
#: bytes of text of which windows are linked and packed at once
BATCH_BYTES = 4 << 20
RESULT = "doc_id long, start long, words long, ref_doc_id long, ref_start long"

#: window place, number of windows, row and window place of what they are linked to
RUN = np.dtype([("at", "<u4"), ("n", "<u4"), ("ref", "<i8"), ("ref_at", "<u4")])
#: the same with the row first, as links of a batch travel to the row they are linked to
LINK = np.dtype([("row", "<i8"), ("at", "<u4"), ("n", "<u4"), ("ref_at", "<u4")])
#: one window linked to one of another batch
OUT = np.dtype([("at", "<u4"), ("ref", "<i8"), ("ref_at", "<u4")])


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, the first row included."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(begin: np.ndarray, n: int) -> np.ndarray:
    return np.r_[begin[1:], n] if len(begin) else begin


def windows_of(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a batch of texts: hash, second hash, row, and first word's place in the row."""
    words = Words(column)
    w = words.hashes()
    h = windows(w, least)
    at = np.flatnonzero(np.arange(len(h)) + least <= np.repeat(words.first[1:], words.count)[: len(h)])
    h = h[at]
    other = mix(w[at] * np.uint64(0x9FB21C651E98DF25) + w[at + (least - 1)] * np.uint64(0xD6E8FEB86659FD93) + (w[at + least // 2] ^ w[at + least // 3]))
    rows = np.searchsorted(words.first, at, "right") - 1
    return h, other, rows, at - words.first[rows]


def linked(h: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a window is the first of its class, the index of that first window), in the order of
    rows and places."""
    order = np.argsort(h, kind="stable")
    begin = _cuts(h[order])
    first = np.empty(len(h), np.int64)
    first[order] = np.repeat(order[begin], np.diff(np.r_[begin, len(h)]))
    return first == np.arange(len(h)), first


def runs(row: np.ndarray, at: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs that go on in the same ref, put together; sorted by row and place."""
    if not len(row):
        return row, at, n, ref, ref_at
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (ref_at[1:] != ref_at[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    return row[begin], at[begin], np.add.reduceat(n, begin), ref[begin], ref_at[begin]


def _packed(bucket: np.ndarray, h: np.ndarray, uid: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Windows in the order of rows and places as one record for each bucket: keys, rows, numbers of
    windows of each row, and steps from place to place."""
    order = np.argsort(bucket, kind="stable")
    bucket, uid, at = bucket[order], uid[order], at[order]
    key = np.ascontiguousarray(h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    begin = _cuts(bucket)
    for i, j in zip(begin.tolist(), _ends(begin, len(bucket)).tolist()):
        own = _cuts(uid[i:j])
        step = at[i:j].astype(np.int64)
        step[1:] -= at[i : j - 1]
        step[own] = at[i:j][own]
        wide = step >= 65535
        small = np.where(wide, 65535, step).astype("<u2").tobytes()
        ids = uid[i:j][own]
        counts = np.diff(np.r_[own, j - i])
        short = not (counts > 255).any()
        yield int(bucket[i]), key[i:j].tobytes(), _ids(ids), (b"\1" if short else b"\4") + counts.astype(np.uint8 if short else "<u4").tobytes(), small + step[wide].astype("<u4").tobytes()


def _ids(ids: np.ndarray) -> bytes:
    """Row keys as the first one and the steps to the next ones, or whole where steps are wide."""
    steps = np.diff(ids)
    if len(steps) and np.abs(steps).max() >= 1 << 31:
        return b"w" + ids.astype("<i8").tobytes()
    return b"s" + ids[:1].astype("<i8").tobytes() + steps.astype("<i4").tobytes()


def _unpacked(keys: bytes, ids: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(keys) // KEY_BYTES
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(n, KEY_BYTES)
    count = np.frombuffer(counts, np.uint8 if counts[0] == 1 else "<u4", offset=1)
    if ids[:1] == b"w":
        own = np.frombuffer(ids, "<i8", offset=1)
    else:
        own = np.frombuffer(ids, "<i8", 1, 1)[0] + np.r_[0, np.cumsum(np.frombuffer(ids, "<i4", offset=9), dtype=np.int64)]
    step = np.frombuffer(steps, "<u2", n).astype(np.int64)
    step[step == 65535] = np.frombuffer(steps, "<u4", offset=2 * n)
    at = np.cumsum(step)
    begin = np.r_[0, np.cumsum(count.astype(np.int64))[:-1]]
    at -= np.repeat(at[begin] - step[begin], count)
    return wide.view("<u8").ravel(), np.repeat(own, count), at


def _by_owner(owner: np.ndarray, data: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Records of sorted owners as one blob for each."""
    begin = _cuts(owner)
    return owner[begin].tolist(), [data[i:j].tobytes() for i, j in zip(begin.tolist(), _ends(begin, len(owner)).tolist())]


_SHUFFLED = "bucket long, keys binary, ids binary, counts binary, steps binary, owner long, data binary"
_LOCAL, _GLOBAL = 0, 1


def _shuffled(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    names = ["bucket", "keys", "ids", "counts", "steps", "owner", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)


def _probe(column: pa.Array, uids: np.ndarray, bits: int, least: int) -> pa.RecordBatch:
    """The first windows of their classes in a batch, packed by bucket, and the other windows' links
    to them, in buckets of their own below 0 by the row that they are linked to."""
    h, other, rows, at = windows_of(column, least)
    first, to = linked(h, rows, at)
    bucket = (other >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
    uid = uids[rows]
    out = [(*r, None, None) for r in _packed(bucket[first], h[first], uid[first], at[first])]
    rest = np.flatnonzero(~first)
    row, place, n, ref, ref_at = runs(uid[rest], at[rest], np.ones(len(rest), np.int64), uid[to[rest]], at[to[rest]])
    data = np.empty(len(row), LINK)
    data["row"], data["at"], data["n"], data["ref_at"] = row, place, n, ref_at
    order = np.argsort(ref, kind="stable")
    for owner, blob in zip(*_by_owner(ref[order], data[order])):
        out.append((-1 - (owner & ((1 << bits) - 1)), None, None, None, None, owner, blob))
    return _shuffled(out)


def _meet(group: pa.Table) -> pa.Table:
    """(owner, kind, data): the links of a bucket's windows to the first one of their class, by their
    row; links of a batch pass through."""
    names = ("keys", "ids", "counts", "steps")
    if group.column("bucket")[0].as_py() < 0:
        return pa.table({"owner": group.column("owner"), "kind": pa.array([_LOCAL] * len(group), pa.int32()), "data": group.column("data")})
    parts = [_unpacked(*x) for x in zip(*(group.column(c).to_pylist() for c in names))]
    key, uid, at = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    key, uid, at = key[same], uid[order[same]], at[order[same]]
    order = np.lexsort((at, uid, key))
    key, uid, at = key[order], uid[order], at[order]
    begin = _cuts(key)
    size = np.diff(np.r_[begin, len(key)])
    ref, ref_at = np.repeat(uid[begin], size), np.repeat(at[begin], size)
    later = np.ones(len(key), bool)
    later[begin] = False
    order = np.flatnonzero(later)
    order = order[np.argsort(uid[order], kind="stable")]
    data = np.empty(len(order), OUT)
    data["at"], data["ref"], data["ref_at"] = at[order], ref[order], ref_at[order]
    owner, blobs = _by_owner(uid[order], data)
    return pa.table({"owner": pa.array(owner, pa.int64()), "kind": pa.array([_GLOBAL] * len(owner), pa.int32()), "data": pa.array(blobs, pa.binary())})


def resolve(owner: np.ndarray, out: np.ndarray, link_ref: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of single rows from links between batches (owner, OUT) and links within batches to owners
    (link_ref, LINK): what a link within a batch leads to may itself be linked further."""
    order = np.lexsort((out["at"], owner))
    owner, out = owner[order], out[order]
    n = link["n"].astype(np.int64)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, at = np.repeat(link["row"], n), np.repeat(link["at"].astype(np.int64), n) + step
    ref, ref_at = np.repeat(link_ref, n), np.repeat(link["ref_at"].astype(np.int64), n) + step
    if len(owner) and len(row):
        ids = np.unique(owner)
        place = np.minimum(np.searchsorted(ids, ref), len(ids) - 1)
        known = ids[place] == ref
        code = np.searchsorted(ids, owner).astype(np.int64) << 32 | out["at"].astype(np.int64)
        wanted = place.astype(np.int64) << 32 | ref_at
        k = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        hit = known & (code[k] == wanted)
        ref, ref_at = np.where(hit, out["ref"][k], ref), np.where(hit, out["ref_at"][k], ref_at)
    row, at = np.r_[owner, row], np.r_[out["at"].astype(np.int64), at]
    ref, ref_at = np.r_[out["ref"], ref], np.r_[out["ref_at"].astype(np.int64), ref_at]
    order = np.lexsort((at, row))
    return runs(row[order], at[order], np.ones(len(row), np.int64), ref[order], ref_at[order])


def _resolved(group: pa.Table) -> pa.Table:
    kind, owner, data = group.column("kind").to_numpy(), group.column("owner").to_numpy(), group.column("data").to_pylist()

    def parts(which: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(kind == which)
        blobs = [data[i] for i in index.tolist()]
        return np.repeat(owner[index], [len(b) // dtype.itemsize for b in blobs]), np.frombuffer(b"".join(blobs), dtype)

    row, at, n, ref, ref_at = resolve(*parts(_GLOBAL, OUT), *parts(_LOCAL, LINK))
    ids, blobs = _by_owner(row, _run_data(at, n, ref, ref_at))
    return pa.table({"row": pa.array(ids, pa.int64()), "runs": pa.array(blobs, pa.binary())})


def _run_data(at, n, ref, ref_at) -> np.ndarray:
    data = np.empty(len(at), RUN)
    data["at"], data["n"], data["ref"], data["ref_at"] = at, n, ref, ref_at
    return data


def _merged(group: pa.Table) -> pa.Table:
    """The runs of each row, that came from several places, as one blob sorted by place."""
    blobs = group.column("runs").to_pylist()
    row = np.repeat(group.column("row").to_numpy(), [len(b) // RUN.itemsize for b in blobs])
    data = np.frombuffer(b"".join(blobs), RUN)
    order = np.lexsort((data["at"], row))
    row, data = row[order], data[order]
    row, at, n, ref, ref_at = runs(row, data["at"].astype(np.int64), data["n"].astype(np.int64), data["ref"], data["ref_at"].astype(np.int64))
    ids, out = _by_owner(row, _run_data(at, n, ref, ref_at))
    return pa.table({"row": pa.array(ids, pa.int64()), "runs": pa.array(out, pa.binary())})


def islands(row: int, own: np.ndarray) -> Iterator[tuple[int, bytes, bool]]:
    """(ref, runs, whether there is but one run) for each stretch of neighbouring runs of a row and
    each other row that one of them is linked to. Beyond a stretch nothing can be extended, for its
    neighbours are first of their class or alone in it."""
    begin = np.flatnonzero(np.r_[True, own["at"][1:] != own["at"][:-1] + own["n"][:-1]])
    for i, j in zip(begin.tolist(), np.r_[begin[1:], len(own)].tolist()):
        part = own[i:j]
        for ref in np.unique(part["ref"]).tolist():
            if ref != row:
                yield ref, part.tobytes(), j - i == 1


class _Classes:
    """The classes of a row's windows: the place in its class's first row, or its own."""

    def __init__(self, row: int, own: np.ndarray):
        self.row, self.at, self.n = row, own["at"].tolist(), own["n"].tolist()
        self.ref, self.ref_at = own["ref"].tolist(), own["ref_at"].tolist()
        self.starts = own["at"]

    def forward(self, at: int) -> tuple[int, int, int, bool]:
        """(row, place, windows from here on that go on like this, whether linked)."""
        k = int(np.searchsorted(self.starts, at, "right")) - 1
        if k >= 0 and at < self.at[k] + self.n[k]:
            return self.ref[k], self.ref_at[k] + at - self.at[k], self.at[k] + self.n[k] - at, True
        return self.row, at, (self.at[k + 1] - at if k + 1 < len(self.at) else 1 << 60), False

    def backward(self, at: int) -> tuple[int, int, int, bool]:
        """The same, with the windows from here back."""
        k = int(np.searchsorted(self.starts, at, "right")) - 1
        if k >= 0 and at < self.at[k] + self.n[k]:
            return self.ref[k], self.ref_at[k] + at - self.at[k], at - self.at[k] + 1, True
        return self.row, at, (at - (self.at[k] + self.n[k] - 1) if k >= 0 else at + 1), False


def extend(row: int, part: np.ndarray, ref: int, whole: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, ref place, windows) of maximal repeats of a stretch of runs of row and the row ref,
    whose runs are whole: each window of the stretch that is linked to ref lies in one, the first of
    several if there are more."""
    a, b, out, seen = _Classes(row, part), _Classes(ref, whole), [], -1
    for k in range(len(part)):
        if a.ref[k] != ref or a.at[k] + a.n[k] <= seen:
            continue
        p = max(a.at[k], seen)
        q = a.ref_at[k] + p - a.at[k]
        on = 0
        while True:
            ra, pa_, na, is_linked = a.forward(p + on)
            if not is_linked:
                break
            rb, pb, nb, _ = b.forward(q + on)
            if (ra, pa_) != (rb, pb):
                break
            on += min(na, nb)
        back = 0
        while p - back > 0 and q - back > 0:
            ra, pa_, na, is_linked = a.backward(p - back - 1)
            if not is_linked:
                break
            rb, pb, nb, _ = b.backward(q - back - 1)
            if (ra, pa_) != (rb, pb):
                break
            back += min(na, nb, p - back, q - back)
        seen = p + on
        out.append((p - back, q - back, back + on))
    return out


def repeats(left: str, right: str, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in left, start in right, words) of maximal exact repeats of at least least words of two
    texts. Each window of left that right has lies in one; windows within one that has been found are
    not looked at again, so texts of one repeated word stay cheap."""
    h, _, rows, at = windows_of(pa.array([right, left]), least)
    first, to = linked(h, rows, at)
    rest = np.flatnonzero(~first)
    row, place, n, ref, ref_at = runs(rows[rest], at[rest], np.ones(len(rest), np.int64), rows[to[rest]], at[to[rest]])
    data = _run_data(place, n, ref, ref_at)
    whole, out = data[row == 0], []
    for _, part, _ in islands(1, data[row == 1]):
        out += [(p, q, m + least - 1) for p, q, m in extend(1, np.frombuffer(part, RUN), 0, whole)]
    return out


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, words, ref_doc_id, ref_start): the maximal exact repeats of at least least
    words that a row shares with an earlier one; positions count words from 0. Words are what white
    space separates, compared byte for byte. Rows are ordered by file and place in it.

    For each window of least words that an earlier row has, a repeat is given that holds it, with the
    first row that has it; so every word of a passage that another row has is in some result, two
    rows with the same passage both lead to the first that has it, and n copies give n - 1 results.
    A passage that is longer with a row in between than with the first one comes in pieces that
    overlap. Of several places of a passage in the first row, ties, the first is given. Repeats
    within one row are not reported. Null and empty texts and those of fewer than least words give
    nothing. Repeated rows repeat the first of them whole. Null doc_ids stay null. An empty table
    gives no rows. Whole texts are read; other columns are not, whatever their names.
    """
    texts = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    buckets = buckets_for(docs, 4 << 20, 16)
    bits = buckets.bit_length() - 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                yield _probe(part.column(1), part.column(0).to_numpy(), bits, least)

    met = texts.select(UID, "text").mapInArrow(probe, _SHUFFLED).groupBy("bucket").applyInArrow(_meet, "owner long, kind int, data binary")
    by = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    resolved = met.groupBy(by("owner").alias("part")).applyInArrow(_resolved, "row long, runs binary")
    known = cut(resolved.groupBy(by("row").alias("part")).applyInArrow(_merged, "row long, runs binary"), "runs")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(islands(row, np.frombuffer(blob, RUN)))
                for i in range(0, len(found), 1000):
                    ref, part, alone = zip(*found[i : i + 1000])
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(ref), pa.int64()), pa.array(part, pa.binary()), pa.array(ref, pa.int64()), pa.array(alone, pa.bool_())], ["row", "part", "ref", "alone"])

    stretches = known.mapInArrow(spread, "row long, part binary, ref long, alone boolean")
    whole = known.select(F.col("row").alias("ref"), F.col("runs").alias("whole"))
    met = stretches.where("not alone").join(whole, "ref", "left").select("row", "part", "ref", "whole")
    both = stretches.where("alone").select("row", "part", "ref", F.lit(None).cast("binary").alias("whole")).unionByName(met)

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, part, ref, blob in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(row, p, n + least - 1, ref, q) for p, q, n in extend(row, np.frombuffer(part, RUN), ref, np.frombuffer(blob or b"", RUN))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["row", "start", "words", "ref", "ref_start"])

    out = both.mapInArrow(lengthen, "row long, start long, words long, ref long, ref_start long")
    ids = texts.select(F.col(UID).alias("row"), "doc_id")
    named = out.join(ids, "row").join(ids.select(F.col("row").alias("ref"), F.col("doc_id").alias("ref_doc_id")), "ref")
    return named.select("doc_id", "start", "words", "ref_doc_id", "ref_start")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about BATCH_BYTES of text; a longer text is a piece of its own."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j
