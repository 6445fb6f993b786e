"""Hashed linear scorer over word and character n-grams, trained and applied in numpy.

A text's features are the shares of its grams in each of FAMILIES hash spaces: words, word pairs,
pairs of word shapes, and runs of three and of five bytes. The margin is the sum over families of
the mean weight of the family's grams, so scoring is one gather and one segmented sum a family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphloom.llm.common import Words, mix, windows

BITS = 16
FAMILIES = 5
DIM = FAMILIES << BITS
_SHAPE = np.uint64(0x2545F4914F6CDD1D)


def grams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: feature index of each gram in row order, rows that have any, their begins."""
    words = Words(column)
    h = words.hashes()
    rows = words.rows()
    out = []

    def add(family: int, hashes: np.ndarray, row: np.ndarray) -> None:
        index = (hashes >> np.uint64(64 - BITS)).astype(np.int32) + (family << BITS)
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        out.append((index, row[begin], begin))

    add(0, h, rows)
    pair = windows(h, 2)
    inside = rows[:-1] == rows[1:] if len(rows) else np.zeros(0, bool)
    add(1, pair[inside], rows[:-1][inside])
    length = np.minimum(words.end - words.start, 15).astype(np.uint64)
    first = words.data[words.start] if len(words) else np.zeros(0, np.uint8)
    last = words.data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    kind = lambda b: np.where((b >= 128) | ((b >= 97) & (b <= 122)), 0, np.where((b >= 65) & (b <= 90), 1, np.where((b >= 48) & (b <= 57), 2, 3))).astype(np.uint64)
    same = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        same[1:] = (h[1:] == h[:-1]) & inside
    shape = length + np.uint64(16) * kind(first) + np.uint64(64) * kind(last) + np.uint64(256) * same
    add(2, mix((shape[:-1] * np.uint64(1024) + shape[1:])[inside] * _SHAPE), rows[:-1][inside])
    data, byte_row = words.data.astype(np.uint64), np.repeat(np.arange(len(words.offsets) - 1, dtype=np.int32), np.diff(words.offsets))
    for family, size in ((3, 3), (4, 5)):
        n = max(0, len(data) - size + 1)
        code = np.zeros(n, np.uint64)
        for k in range(size):
            code = code << np.uint64(8) | data[k : k + n]
        whole = byte_row[:n] == byte_row[size - 1 :] if n else np.zeros(0, bool)
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        add(family, code[whole], byte_row[:n][whole])
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (row, feature, share), each row and feature once."""
    parts = []
    for index, rows, begin in grams(column):
        size = np.diff(np.r_[begin, len(index)])
        both = np.repeat(rows.astype(np.int64), size) * DIM + index
        value, count = np.unique(both, return_counts=True)
        total = np.zeros(len(column))
        total[rows] = size
        row = value // DIM
        parts.append((row.astype(np.int32), (value % DIM).astype(np.int32), (count / total[row]).astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def margins(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each row; a row without grams has the bias."""
    out = np.full(len(column), bias, np.float64)
    for index, rows, begin in grams(column):
        if len(index):
            out[rows] += np.add.reduceat(weights[index], begin, dtype=np.float64) / np.diff(np.r_[begin, len(index)])
    return out


def train(texts: pa.Array, target: np.ndarray, rounds: int = 40, rate: float = 1.0, ridge: float = 1e-5, least: int = 5, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (float32, DIM) and bias of a logistic regression on targets in [0, 1], by Adam over
    all rows. Features of fewer than least rows get no weight; share weighs the rows."""
    parts, at = [], 0
    for i in range(0, len(texts), 500):
        row, feature, value = features(texts.slice(i, 500))
        parts.append((row + i, feature, value))
    row, feature, value = (np.concatenate(x) for x in zip(*parts))
    del parts
    often = np.bincount(feature, minlength=DIM) >= least
    keep = often[feature]
    row, feature, value = row[keep], feature[keep], value[keep]
    n = len(texts)
    share = np.full(n, 1.0 / n) if share is None else share / share.sum()
    w, b, m, v, mb, vb = np.zeros(DIM, np.float64), 0.0, np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for at in range(1, rounds + 1):
        z = b + np.bincount(row, w[feature] * value, n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * share
        g = np.bincount(feature, error[row] * value, DIM) + ridge * share.mean() * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**at, 1 - 0.99**at
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.1 * rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w.astype(np.float32), float(b)


def platt(margin: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method with the usual
    smoothed targets."""
    yes, no = float((target > 0.5).sum()), float((target <= 0.5).sum())
    t = np.where(target > 0.5, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (d * margin).sum(), d.sum()
        haa, hab, hbb = (s * margin * margin).sum() + 1e-6, (s * margin).sum(), s.sum() + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(a), float(b)
