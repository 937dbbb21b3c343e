"""Byte-level BPE texts: cutting at safe spaces, memory of resolved pieces.

The pre-token pattern of the byte-level vocabularies attaches one space to
the run that follows it, so a space between two non-space characters always
starts a pre-token. Texts are cut there; a piece's ids do not depend on its
neighbours, and pieces repeat, so a bounded dictionary keeps their ids. Texts
with white space beside a space go through the pattern as a whole.
"""
from __future__ import annotations

from collections.abc import Callable

import regex

# Letters below this code point are letters in every Unicode version in use.
PLAIN_BELOW = "ɐ"


class Memory(dict):
    """key -> ids (little-endian uint32 bytes) of the keys seen of late.

    Two generations of at most ``limit`` keys: a key of the old one moves
    up when it is used. An unknown key gives None and is noted.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.unknown = limit, {}, {}

    def __missing__(self, key: str):
        ids = self.old.get(key)
        if ids is None:
            self.unknown[key] = None
        else:
            self[key] = ids
        return ids

    def take_unknown(self) -> list[str]:
        found, self.unknown = list(self.unknown), {}
        return found

    def age(self) -> None:
        """Between batches only: what a batch looks up stays until its end."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Batches of whole texts to ids (little-endian uint32 bytes per text).

    ``encode_all`` gives the ids of pre-tokens, each encoded alone.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], pattern: str, limit: int = 600_000):
        self.encode_all = encode_all
        self.find = regex.compile(pattern).findall
        self.pieces, self.words = Memory(limit), Memory(limit // 2)

    def _encode_words(self, tokens: list[str], known: dict[str, bytes]) -> None:
        missing = []
        for t in dict.fromkeys(tokens):
            if t not in known:
                ids = self.pieces.get(t[1:]) if t[0] == " " else None  # a piece of this token alone
                known[t] = self.words[t] if ids is None else ids
                if known[t] is None:
                    missing.append(t)
        self.words.unknown = {}
        if missing:
            found = dict(zip(missing, self.encode_all(missing)))
            known.update(found)
            self.words.update(found)

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = self.pieces
        get = pieces.get
        cut: list[list[str] | None] = []
        ids: list[list[bytes | None] | None] = []  # of a text's parts; None: not known yet
        holes: list[list[int]] = []  # where a text's parts are not known
        for text in texts:
            parts = text.split(" ")
            # A part with white space at an end, or an empty one, is no safe cut.
            ok = not parts[0] or not parts[0][-1].isspace()
            if ok and parts[0] and len(parts) > 1:
                rest = iter(parts)
                next(rest)
                found = [b"", *map(get, rest)]
                gaps, at = [], 0
                if None in found:
                    for _ in range(found.count(None)):
                        at = found.index(None, at + 1)
                        gaps.append(at)
                        pieces[parts[at]]  # noted, or moved up from the old generation
                cut.append(parts)
                ids.append(found)
                holes.append(gaps)
            else:
                cut.append(None)
                ids.append(None)
                holes.append([])
        unknown = pieces.take_unknown()
        by_piece: dict[str, list[str]] = {}
        unsafe: set[str] = set()
        single: dict[str, str] = {}  # pieces of one token
        for p in unknown:
            if p.isalpha() and (p.isascii() or max(p) < PLAIN_BELOW):
                single[p] = " " + p
            elif not p or p[0].isspace() or p[-1].isspace():
                unsafe.add(p)
            else:
                by_piece[p] = self.find(" " + p)
        single.update((p, ts[0]) for p, ts in by_piece.items() if len(ts) == 1)
        if single:
            pieces.update(zip(single, self.encode_all(list(single.values()))))
        known: dict[str, bytes] = {}
        several = [p for p, ts in by_piece.items() if len(ts) > 1]
        self._encode_words([t for p in several for t in by_piece[p]], known)
        for p in several:
            pieces[p] = b"".join([known[t] for t in by_piece[p]])
        whole: dict[int, list[str]] = {}
        for i, (text, parts) in enumerate(zip(texts, cut)):
            # Only pieces that were not known are looked up again.
            for at in holes[i]:
                if parts[at] in unsafe:
                    parts = ids[i] = None
                    break
                ids[i][at] = pieces[parts[at]]
            whole[i] = self.find(parts[0] if parts else text)
        self._encode_words([t for ts in whole.values() for t in ts], known)
        out = []
        for i, found in enumerate(ids):
            head = b"".join([known[t] for t in whole[i]])
            if found:
                found[0] = head
                head = b"".join(found)
            out.append(head)
        pieces.age()
        self.words.age()
        return out
