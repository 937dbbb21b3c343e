"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings answers
whole pre-tokens that are vocabulary entries. Tier two: the rest is merged by
rank with a heap over linked bytes. Both work on single pre-tokens, so no
step needs more memory than one text.

The hash (displacements, slots, entries: a few MB, bounded by the vocabulary
file) is built once per Python worker from the file named by the caller.

Defined cases: null text counts as empty and gives no ids; repeated rows keep
one output row each; an empty table gives an empty table; extra columns are
ignored.
"""
from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty
from .pretokens import TextEncoder


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one probe.

    Keys fall into buckets by their hash; large buckets first, every bucket
    gets a displacement that sends its keys to free slots, a bucket of one
    key names its slot directly.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n  # slot -> index of the key
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            members[h % self.buckets].append((h, i))
        free = n - 1
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                d = 1
                while True:
                    at = [self._slot(h, d) for h, _ in own]
                    if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for s, (_, i) in zip(at, own):
                    self.slots[s] = i
            elif own:
                while self.slots[free] >= 0:
                    free -= 1
                self.shift[b] = -free - 1
                self.slots[free] = own[0][1]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 32) & 0xFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """Index the key would have; the caller compares the stored key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._slot(h, d)]


class Vocabulary:
    """Ranks of a vocabulary file: one base64 string and one rank per line."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        self.keys = [k for k, _ in entries]
        self.ids = [i for _, i in entries]
        self.hash = PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in entries}
        self.packed = {i: i.to_bytes(4, "little") for i in self.ids}
        self.ranks = dict(entries)  # merge ranks of the second tier

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls([(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, f))])

    def rank(self, piece: bytes) -> int:
        """First tier: the id of a whole pre-token, or -1 if it is no entry."""
        at = self.hash.find(piece)
        return self.ids[at] if self.keys[at] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: lowest-ranked neighbouring pair
        first, leftmost on ties, by a heap over linked bytes."""
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end[i]: end of the part that starts at i
        start = list(range(-1, n))  # start[e]: start of the part that ends at e
        pair = [rank(piece[i:i + 2], -1) for i in range(n - 1)]  # rank of part i with its next one
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:  # the pair has changed since
                continue
            j = end[i]
            k = end[i] = end[j]
            pair[j] = -1
            if k < n:
                start[k] = i
                r = pair[i] = rank(piece[i:end[k]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            if i:
                s = start[i]
                r = pair[s] = rank(piece[s:k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | s)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode_pretoken(self, token: str) -> bytes:
        piece = token.encode("utf-8")
        r = self.rank(piece)
        return self.packed[r] if r >= 0 else b"".join([self.packed[i] for i in self.merge(piece)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], tuple[Vocabulary, TextEncoder]] = {}


def codec(path: str, pattern: str) -> tuple[Vocabulary, TextEncoder]:
    """Vocabulary and encoder of this Python worker, built once."""
    if (path, pattern) not in _LOADED:
        v = Vocabulary.load(path)
        _LOADED[path, pattern] = v, TextEncoder(lambda ts: [v.encode_pretoken(t) for t in ts], pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian uint32 bytes) per row.

    With ``digests`` the ids are decoded again and their SHA-256 and that of
    the decoded bytes (``ids_sha256``, ``decoded_sha256``) stand in place of ids.
    """
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"

    def run(batches):
        vocabulary, encoder = codec(path, pattern)
        for b in batches:
            n, cols = [], [[], []]
            for ids in encoder(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                if digests:
                    cols[0].append(hashlib.sha256(ids).hexdigest())
                    cols[1].append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                else:
                    cols[0].append(ids)
            out = [b.column(0), pa.array(n, pa.int64())]
            if digests:
                out += [pa.array(c, pa.string()) for c in cols]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out.append(pa.array(cols[0], pa.binary()))
                names = ["doc_id", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")


def decode(encoded: DataFrame, path: str, pattern: str = "") -> DataFrame:
    """``doc_id`` and ``text`` of an encoded table; null ids give null text,
    bytes that are no UTF-8 become U+FFFD."""
    bound_batches(encoded.sparkSession)

    def run(batches):
        vocabulary, _ = codec(path, pattern)
        for b in batches:
            texts = [None if i is None else vocabulary.decode(i).decode("utf-8", "replace")
                     for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
