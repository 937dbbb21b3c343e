"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's ids are
taken in order: whole windows' worth goes out as full sequences, the rest is
placed best-fit (the open window it leaves the least room in). Where none
fits, the fullest window is filled with the head of the rest and emitted.
What is open at the end of a partition goes, with its ids (at most
``open_windows * window`` of them), to a merge of a bounded number of
partitions' leftovers: those are packed the same way, and what is then left
is cut into sequences of a power of two, which need no padding.

So a task holds a fixed number of windows whatever the input, no id is
lost or repeated, and only leftovers cross a shuffle.

Defined cases: null text counts as empty (its one id is the end id); repeated
rows are packed as separate documents; null doc_id keeps its pieces; a text
longer than a window spans several sequences; an empty table gives an empty
table; extra columns are ignored.
"""
from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty, written
from .pretokens import PLAIN_BELOW, TextEncoder

# Sequence ids: partition (or merge group) number above, running number below.
RUN_BITS = 32
MERGE_BASE = 1 << 30
FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: object
    start: int
    ids: bytes  # little-endian uint32
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.ids[:4 * n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.doc_tokens))


@dataclass
class Window:
    used: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, p: Piece) -> None:
        self.pieces.append(p)
        self.used += len(p)


class Packer:
    """Fixed number of open windows; ``put`` yields the windows it fills."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.limit = window, open_windows
        self.open: list[Window] = []

    def put(self, p: Piece) -> Iterator[Window]:
        while len(p) >= self.window:
            head, p = p.split(self.window)
            yield Window(self.window, [head])
        while len(p):
            n = len(p)
            fits = [w for w in self.open if w.used + n <= self.window]
            if fits:
                best = max(fits, key=lambda w: w.used)
                best.add(p)
                p = p.split(n)[1]
            elif len(self.open) < self.limit:
                best = Window()
                self.open.append(best)
                best.add(p)
                return
            else:
                best = max(self.open, key=lambda w: w.used)
                head, p = p.split(self.window - best.used)
                best.add(head)
            if best.used == self.window:
                self.open.remove(best)
                yield best

    def powers_of_two(self) -> Iterator[Window]:
        """Close the packer: the open windows' ids as full windows, then as
        sequences of falling powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w.used) for p in w.pieces]
        self.open = []
        left = sum(map(len, pieces))
        room, out = 0, Window()
        for p in pieces:
            while len(p):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                head, p = p.split(min(room, len(p)))
                out.add(head)
                room -= len(head)
                left -= len(head)
                if not room:
                    yield out
                    out = Window()


def _rows(windows: Iterator[Window], base: int) -> Iterator[tuple]:
    for k, w in enumerate(windows):
        at = 0
        for p in w.pieces:
            yield (p.doc_id, p.start, len(p), p.ids, p.doc_tokens, (base << RUN_BITS) + k, at)
            at += len(p)


# Fixed value: how the vocabulary file writes a leading space.
SPACE_SIGN = "\u0120"
WORDS_AT_ONCE = 64

_ENCODERS: dict[tuple, JsonEncoder] = {}


class JsonEncoder:
    """Batches of whole texts to ids, as the library's plain call gives them.

    A text that holds the string of one of the file's added tokens goes through that
    call as a whole; all others through the memory of pieces.
    """

    def __init__(self, path: str, added: list[str], pieces: TextEncoder):
        self.path, self.added, self.pieces = path, added, pieces
        self.sign = os.path.commonprefix(added)  # what every added token starts with

    @functools.cached_property
    def plain(self):
        """The library's tokenizer as the file says; loaded when a text needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self.added and self.sign in t and any(a in t for a in self.added)}
        rest = iter(self.pieces([t for i, t in enumerate(texts) if i not in whole]))
        return [np.array(self.plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if i in whole else next(rest)
                for i, t in enumerate(texts)]


def json_encoder(path: str, pattern: str) -> JsonEncoder:
    """Encoder of a tokenizers JSON file, one per Python worker. Strings of the
    file's added tokens in a text become their ids, none are put around it."""
    if (path, pattern) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        def one_by_one(tokens: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype="<u4").tobytes()
                    for e in tok.encode_batch_fast(tokens, add_special_tokens=False)]

        # ids whose string starts with the space of a word
        size = tok.get_vocab_size()
        spaced = np.array([(tok.id_to_token(i) or "").startswith(SPACE_SIGN) for i in range(size)])

        def encode_all(tokens: list[str]) -> list[bytes]:
            """Plain words (a space, then letters) go through the library many at a
            time: in " one two" a token that starts with a space starts a word."""
            plain = [t for t in tokens if t[0] == " " and t[1:].isalpha() and (t.isascii() or max(t) < PLAIN_BELOW)]
            groups = [plain[i:i + WORDS_AT_ONCE] for i in range(0, len(plain), WORDS_AT_ONCE)]
            found: dict[str, bytes] = {}
            for words, e in zip(groups, tok.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                starts = np.nonzero(spaced[ids])[0].tolist()
                if len(starts) == len(words):
                    raw = ids.tobytes()
                    for w, x, y in zip(words, starts, [*starts[1:], len(ids)]):
                        found[w] = raw[4 * x:4 * y]
            rest = [t for t in tokens if t not in found]
            found.update(zip(rest, one_by_one(rest)))
            return [found[t] for t in tokens]

        _ENCODERS[path, pattern] = JsonEncoder(
            path, [t.content for t in tok.get_added_tokens_decoder().values()], TextEncoder(encode_all, pattern))
    return _ENCODERS[path, pattern]


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1,
         open_windows: int = 32, merge_partitions: int = 64, keep_ids: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id``, ``start`` (ids of its
    document before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (place in the sequence) and, with
    ``keep_ids``, ``ids`` (little-endian uint32 bytes).

    Leftovers of ``merge_partitions`` partitions meet in one merge task.
    """
    spark = docs.sparkSession
    bound_batches(spark, 256)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {FIELDS}, ids_crc32 long, part long, leftover int"
    end = end_id.to_bytes(4, "little")
    id_type = pa.int64() if kind == "bigint" else None

    def batch(rows: list[tuple], part: int, leftover: bool) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*rows)]
        crc = [zlib.crc32(i) for i in cols[3]]
        ids = cols[3] if keep_ids or leftover else [None] * len(rows)
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(ids, pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()),
             pa.array(cols[6], pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int64()),
             pa.array([int(leftover)] * n, pa.int32())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32",
                   "part", "leftover"])

    def run(batches):
        part = TaskContext.get().partitionId()
        encoder, packer, done = json_encoder(path, pattern), Packer(window, open_windows), 0
        for b in batches:
            full: list[Window] = []
            for d, ids in zip(b.column(0).to_pylist(), encoder(b.column(1).to_pylist())):
                ids += end
                full.extend(packer.put(Piece(d, 0, ids, len(ids) // 4)))
            if full:
                base = part << RUN_BITS
                rows = [r[:5] + (base + done + (r[5] & 0xFFFFFFFF),) + r[6:] for r in _rows(iter(full), 0)]
                done += len(full)
                yield batch(rows, part, False)
        if packer.open:
            yield batch(list(_rows(iter(packer.open), 0)), part, True)

    placed = written(src.mapInArrow(run, schema), "packed")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, full = Packer(window, open_windows), []
        for r in pdf.sort_values(["part", "sequence_id", "offset"]).itertuples(index=False):
            doc = None if pd.isna(r.doc_id) else r.doc_id
            full.extend(packer.put(Piece(doc, int(r.start), bytes(r.ids), int(r.doc_tokens))))
        full.extend(packer.powers_of_two())
        rows = list(_rows(iter(full), MERGE_BASE + int(key[0])))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        out["ids_crc32"] = [zlib.crc32(i) for i in out["ids"]]
        if kind == "bigint":
            out["doc_id"] = out["doc_id"].astype("Int64")
        return out if keep_ids else out.assign(ids=None)

    left = placed.where("leftover = 1").withColumn("grp", F.floor(F.col("part") / merge_partitions))
    merged = left.groupBy("grp").applyInPandas(merge, f"doc_id {kind}, {FIELDS}, ids_crc32 long")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.where("leftover = 0").select(*cols).unionByName(merged.select(*cols))
