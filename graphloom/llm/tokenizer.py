"""Byte-level BPE of a public vocabulary file, with a bounded cache of space-delimited chunks.

A space that stands between two other non-space characters always begins a new piece of the
vocabulary's split pattern, so a text may be cut there and each chunk encoded on its own. Texts
with other white space around a space are cut only at the safe places.
"""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 150_000
_UNSAFE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")

_made: dict[str, "Tokenizer"] = {}


class _Counts(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk):
        n = len(self.encode(" " + chunk))
        if len(self) < CACHE_ENTRIES:
            self[chunk] = n
        return n


class _Ids(_Counts):
    def __missing__(self, chunk):
        ids = np.array(self.encode(" " + chunk), np.uint32).tobytes()
        if len(self) < CACHE_ENTRIES:
            self[chunk] = ids
        return ids


class Tokenizer:
    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("graphloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self._count, self._ids = _Counts(self.encode), _Ids(self.encode)

    @staticmethod
    def _chunks(text: str) -> tuple[str, list[str]]:
        if _UNSAFE.search(text) or text[:1] == " " or text[-1:] == " ":
            chunks = _SAFE_CUT.split(text)
        else:
            chunks = text.split(" ")
        return chunks[0], chunks[1:]

    def count(self, text: str) -> int:
        if not text:
            return 0
        head, rest = self._chunks(text)
        return len(self.encode(head)) + sum(map(self._count.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        head, rest = self._chunks(text)
        return np.frombuffer(np.array(self.encode(head), np.uint32).tobytes() + b"".join(map(self._ids.__getitem__, rest)), np.uint32)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One tokenizer for each process and vocabulary."""
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]
