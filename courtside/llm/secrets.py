"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Base spans come from three patterns over the whole text. A CRF with the tags
outside, begin and inside reads every token of the text and adds spans:
features are a token's shape, length and letter mix, its neighbouring words and
marks, whether it is quoted or stands behind a credential-like name, and facts
about the file; Viterbi gives the best tag sequence of the whole text.

Emissions are sums of parts that depend on one token each (its own look, the
word before, after, the name before a mark), so a task looks a part up once per
distinct token and adds whole arrays. Viterbi runs over blocks of a fixed
length side by side, joined by max-plus products: the exact best sequence, in
time linear in the text, for texts of any length.

The CRF is trained here, by likelihood, on a bounded sample of windows of
``longest`` tokens: at most ``sample_windows`` with a base span and as many
without, at most ``per_document`` of either sort from a document, those with the
smallest hash of their text. They come from the documents with the smallest
hashes, about ``sample_docs``; where these hold too few base spans, windows with one
come from eight times as many, and so on up to all. Tokens inside base spans carry begin and
inside. In copies of the windows the name before the value is hidden, or the mark
between them, so values are also told by their own look or a name alone. Base spans stay as they are; a CRF span that
touches one is dropped.

Defined cases: null text counts as empty; a table without base spans trains
nothing and adds nothing; repeated rows keep one output row each; an empty
table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty, written

KINDS = ("assign", "access", "hex", "crf")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns. Letters of the names in either case (A-Z only).
NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")),
                  _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
MARKS = ("password", "passwd", "secret", "token", "api")

Span = tuple[int, int, int, int]  # start, kind, end, start of the value


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, too short ones dropped."""
    out = []
    low = text.lower()
    if any(m in low for m in MARKS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is found at its own start: the same as all runs, short ones dropped.
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def listing(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


# A token is a maximal run of characters that are neither white space, quotes,
# brackets, list signs nor marks; a mark (= or :) is a token of its own.
SIGNS = "\"'`,;|<>(){}[]"
CLASS = np.zeros(0x110000, np.uint8)  # of a code point: 1 between tokens, 2 a mark, 0 in a token
CLASS[[i for i in range(0x110000) if chr(i).isspace()] + [ord(c) for c in SIGNS]] = 1
CLASS[[ord("="), ord(":")]] = 2
# Credential-like names, inside a token or as a whole one.
NAMED = re.compile(r"""pass(?:word|wd|phrase|code)|pwd|secret|token|credential|(?:api|access|private)[_-]?key
    |^(?:pass|pw|psk|pin|auth)$""", re.IGNORECASE | re.VERBOSE)
AFTER_NAME = 3  # tokens behind a name that count as named
CLOSERS = ".!?#$%&*"  # closing punctuation is no part of a secret
NO_DIGITS = str.maketrans("", "", "0123456789")
HEX_SIGNS = "0123456789abcdefABCDEF"
GROUP_CHARS = 1_000_000  # characters of texts that are tagged together
KNOWN_TOKENS = 300_000  # distinct tokens whose parts a task remembers


def shape(token: str) -> str:
    """The first eight runs of upper case, lower case, digits and other characters, e.g. ``Aa0``."""
    out: list[str] = []
    for c in token:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "+/_.-" else "#"
        if not out or out[-1] != k:
            if len(out) == 8:
                return "".join(out) + "*"
            out.append(k)
    return "".join(out)


def file_facts(text: str) -> list[str]:
    """Facts about the whole file, shared by its tokens."""
    n, lines = len(text), text.count("\n") + 1
    signs = sum(text.count(c) for c in "=:;{}()")
    return [f"file:lines:{min(lines, 64).bit_length()}", f"file:signs:{min(9, 200 * signs // max(1, n))}",
            f"file:words:{min(text.count(' '), 1 << 12).bit_length()}", f"file:quotes:{text.count(chr(34)) > 0}"]


Look = tuple[str, int, int, int, int, bool, bool, int]


def look(token: str) -> Look | None:
    """What a token looks like: shape, length, shares of digits, upper case and different
    characters, hexadecimal, digits only ("" where the text ends: None)."""
    if not token:
        return None
    t = token.rstrip(CLOSERS) or token
    n = len(t)
    size = min(n, 48)
    kinds = len(set(t)) * 8 // n
    is_hex = not t.strip(HEX_SIGNS)
    if t.isalpha():  # words, capitalised or not, as the general way below has them
        upper = n > 1 and t[0].isupper() and t[1:].islower()
        if upper or t.islower():
            return "Aa" if upper else "a", size // 4, 0, 4 * upper // n, kinds, is_hex, False, size // 8
    digits = n - len(t.translate(NO_DIGITS))
    uppers = sum(map(str.isupper, t))
    return shape(t), size // 4, 8 * digits // n, 4 * uppers // n, kinds, is_hex, digits == n, size // 8


LOOK_FEATURES = 8


def own_look(token: str) -> list[str]:
    """Feature names of a token's own look."""
    return _look_names(look(token))


def _look_names(seen: Look | None) -> list[str]:
    if seen is None:
        return []
    form, size, digits, uppers, kinds, is_hex, all_digits, wide = seen
    return ["bias", f"shape:{form}", f"len:{size}", f"digits:{digits}", f"upper:{uppers}", f"kinds:{kinds}",
            f"hex:{is_hex}:{wide}", f"alldigits:{all_digits}"]


def word(token: str) -> str:
    """A neighbour as its features name it: lower case, or its shape where it has digits."""
    return token.lower() if token.isalpha() or not any(map(str.isdigit, token)) else shape(token)


def signs(mark: bool, quoted: bool, named: int) -> list[str]:
    return [f"mark:{mark}", f"quoted:{quoted}", f"mark+quoted:{mark}{quoted}", f"named:{named}"]


VIEWS = ("", "name", "mark")  # what a training copy of a window hides


def token_features(tokens: list[str], i: int, quoted: bool, named: int, facts: list[str], hide: str = "") -> list[str]:
    """Feature names of token i (``tokens`` reach two before and one after it).
    ``hide``: ``name`` leaves out the name before it, ``mark`` the mark between."""
    mark = tokens[i - 1] in ("=", ":")
    before, name = tokens[i - 1], tokens[i - 2] if mark else None
    if hide == "name":
        before, name, named = (before if mark else None), None, 0
    elif hide == "mark" and mark:
        mark, before, name = False, name, None
    say = lambda w: "?" if w is None else word(w)
    return [*own_look(tokens[i]), f"before:{say(before)}", f"after:{word(tokens[i + 1])}", f"name:{say(name)}",
            *signs(mark, quoted, named), *facts]


@dataclass
class Tokens:
    """All tokens of a group of texts, one after the other."""
    texts: list[str]
    of: np.ndarray  # text of each token
    start: np.ndarray  # within its text, end exclusive
    end: np.ndarray
    words: list[str]
    quoted: np.ndarray
    first: np.ndarray  # first token of its text

    def shifted(self, values: np.ndarray, by: int, fill) -> np.ndarray:
        """``values`` of the token ``by`` places before (behind, where negative) in the same text."""
        out = np.full(len(values), fill, dtype=values.dtype)
        if by > 0 and len(values) > by:
            out[by:] = np.where(self.of[by:] == self.of[:-by], values[:-by], fill)
        elif by < 0 and len(values) > -by:
            out[:by] = np.where(self.of[:by] == self.of[-by:], values[-by:], fill)
        return out


def tokenise(texts: list[str]) -> Tokens:
    of, start, end, words, quoted = [], [], [], [], []
    for k, text in enumerate(texts):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = CLASS[code]
        # A token begins at a mark, and where a character in a token follows one that is not.
        begins = np.flatnonzero((kind == 2) | ((kind == 0) & (np.concatenate([[1], kind[:-1]]) != 0)))
        ends = np.flatnonzero((kind == 2) | ((kind == 0) & (np.concatenate([kind[1:], [1]]) != 0))) + 1
        of.append(np.full(len(begins), k))
        start.append(begins)
        end.append(ends)
        words += [text[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        before = code[np.maximum(begins - 1, 0)]
        quoted.append((begins > 0) & ((before == 34) | (before == 39) | (before == 96)))
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    of = cat(of, np.int64)
    return Tokens(texts, of, cat(start, np.int64), cat(end, np.int64), words, cat(quoted, bool),
                  np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool))


def is_name(token: str) -> bool:
    return NAMED.search(token) is not None


def named_after(t: Tokens, mark: np.ndarray, name: np.ndarray) -> np.ndarray:
    """How many tokens (marks not counted) before each stands the nearest credential-like
    name: 1 to ``AFTER_NAME``, 0 where there is none so near."""
    out = np.zeros(len(t.words), np.int64)
    if name.any():
        at = np.flatnonzero(~mark)
        of, name = t.of[at], name[at]
        for by in range(AFTER_NAME, 0, -1):
            out[at[by:][name[:-by] & (of[by:] == of[:-by])]] = by
    return out


@dataclass
class Crf:
    """Weights per feature and tag (outside, begin, inside), and of tag pairs."""
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def weight(self, features: list[str]) -> np.ndarray:
        return self.weights[[j for f in features if (j := self.index.get(f)) is not None]].sum(axis=0)


class Tagger:
    """A CRF at work in a task. For each distinct token it remembers which rows of the
    weight tables it takes: of its own look, and as the word before, after, and as the
    name (row 0 has no weight), and whether it is a credential-like name."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.rows: dict[str, int] = {}
        self.takes = np.zeros((0, 5), np.int32)
        self.signs = np.array([crf.weight(signs(bool(i & 1), bool(i & 2), i >> 2)) for i in range(4 * (AFTER_NAME + 1))])
        self.no_name = crf.weight(["name:?"])
        self.looks: dict[Look | None, int] = {}
        self.own = np.zeros((0, 3))
        self.weights = np.concatenate([crf.weights, np.zeros((1, 3))])  # the last row: no such feature
        self.near = []
        self.tables = []
        for kind in ("before:", "after:", "name:"):
            known = [(f[len(kind):], j) for f, j in crf.index.items() if f.startswith(kind)]
            self.near.append({w: k for k, (w, _) in enumerate(known, 1)})
            self.tables.append(np.concatenate([np.zeros((1, 3)), crf.weights[[j for _, j in known]].reshape(-1, 3)]))

    def _remember(self, tokens: list[str]) -> None:
        looks, (before, after, name), fresh, found = self.looks, self.near, [], []
        for t in tokens:
            self.rows[t] = len(self.rows)
            seen, near = look(t), word(t)
            if seen not in looks:
                looks[seen] = len(looks)
                fresh.append([self.crf.index.get(f, -1) for f in _look_names(seen)] or [-1] * LOOK_FEATURES)
            found.append((looks[seen], before.get(near, 0), after.get(near, 0), name.get(near, 0), is_name(t)))
        if fresh:
            self.own = np.concatenate([self.own, self.weights[np.array(fresh)].sum(axis=1)])
        if found:
            self.takes = np.concatenate([self.takes, np.array(found, np.int32)])

    def emissions(self, t: Tokens) -> np.ndarray:
        if len(self.rows) > KNOWN_TOKENS:
            self.rows, self.takes = {}, np.zeros((0, 5), np.int32)
        self._remember([w for w in {"", "=", ":", *t.words} if w not in self.rows])
        ids = np.fromiter(map(self.rows.__getitem__, t.words), np.int64, len(t.words))
        none = self.rows[""]
        before = t.shifted(ids, 1, none)
        mark = (before == self.rows["="]) | (before == self.rows[":"])
        e = self.own[self.takes[ids, 0]]
        e += self.tables[0][self.takes[before, 1]]
        e += self.tables[1][self.takes[t.shifted(ids, -1, none), 2]]
        e += self.no_name
        at = np.flatnonzero(mark)
        e[at] += self.tables[2][self.takes[t.shifted(ids, 2, none)[at], 3]] - self.no_name
        is_mark = (ids == self.rows["="]) | (ids == self.rows[":"])
        named = named_after(t, is_mark, self.takes[ids, 4] > 0)
        e += self.signs[mark + 2 * t.quoted + 4 * named]
        return e + np.array([self.crf.weight(file_facts(x)) for x in t.texts])[t.of]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text: the spans that the best tag sequence marks, without closing punctuation."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        t = tokenise(texts)
        if not self.crf.index or not len(t.of):
            return out
        tags = decode(self.emissions(t), t.first, self.crf.moves)
        for i in np.flatnonzero(tags):
            w, a, own = t.words[i], int(t.start[i]), out[t.of[i]]
            b = a + (len(w.rstrip(CLOSERS)) or len(w))
            if tags[i] == 1:
                own.append((a, b))
            else:
                own[-1] = (own[-1][0], b)
        return out


NEVER = -1e9
START = np.array([0.0, 0.0, NEVER])  # a sequence does not start inside
FORBIDDEN = np.array([[0.0, 0.0, NEVER], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])  # nor goes from outside to inside


def decode(e: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """Viterbi: the best tags of each text's tokens. ``first`` marks where a text begins.

    All texts are one chain, in which the step to a first token forgets the tag
    before. Blocks of the chain are worked off side by side: their max-plus
    products give the scores at every block's entry, from there back pointers are
    set in all blocks at once, and followed back likewise.
    """
    n = len(e)
    rows = -(-n // block)
    pad = rows * block - n
    # Rows last: every step is plain arithmetic on long arrays, [tag, row] or [from, to, row].
    e = np.ascontiguousarray(np.concatenate([e, np.zeros((pad, 3))]).reshape(rows, block, 3).transpose(1, 2, 0))
    first = np.ascontiguousarray(np.concatenate([first, np.ones(pad, bool)]).reshape(rows, block).T)
    moves = (moves + FORBIDDEN)[:, :, None]
    start = np.broadcast_to(START, (3, 3))[:, :, None]
    step = lambda i: np.where(first[i], start, moves)
    product = np.tile(np.where(np.eye(3, dtype=bool), 0.0, NEVER)[:, :, None], (1, 1, rows))
    for i in range(block):
        s = step(i)
        ways = [product[:, k, None] + s[None, k] for k in range(3)]
        product = np.maximum(np.maximum(ways[0], ways[1]), ways[2]) + e[i]
    entry = np.zeros((3, rows))
    for r in range(rows - 1):
        score = (entry[:, r, None] + product[:, :, r]).max(axis=0)
        entry[:, r + 1] = score - score.max()
    back = np.zeros((block, 3, rows), np.int8)
    score = entry
    for i in range(block):
        s = step(i)
        ways = [score[k] + s[k] for k in range(3)]
        best = np.maximum(np.maximum(ways[0], ways[1]), ways[2])
        back[i] = np.where(ways[0] == best, 0, np.where(ways[1] == best, 1, 2))
        score = best + e[i]
    every = np.arange(rows)
    came = np.repeat(np.arange(3)[:, None], rows, axis=1)
    for i in range(block - 1, -1, -1):
        came = back[i][came, every]
    last = np.zeros(rows, np.int64)
    last[-1] = int(score[:, -1].argmax())
    for r in range(rows - 1, 0, -1):
        last[r - 1] = came[last[r], r]
    tags = np.zeros((rows, block), np.int8)
    for i in range(block - 1, -1, -1):
        tags[:, i] = last
        last = back[i][last, every]
    return tags.reshape(-1)[:n]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def train(sequences: list[tuple[list[list[str]], list[int | None]]], epochs: int = 20, rate: float = 0.3,
          ridge: float = 1e-3, min_count: int = 3, size: int = 64) -> Crf:
    """Maximum likelihood by forward-backward gradients (Adagrad, ``size`` sequences a
    step, side by side). A sequence's tags begin and end with its neighbours'
    (None: the text's end)."""
    counts = Counter(f for feats, _ in sequences for fs in feats for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= min_count))}
    crf = Crf(index, np.zeros((len(index), 3)), np.zeros((3, 3)))
    seen_w, seen_m = np.full((len(index), 3), 1e-6), np.full((3, 3), 1e-6)
    data = []
    for feats, tags in sequences:
        cols = [[index[f] for f in fs if f in index] for fs in feats]
        data.append((np.concatenate([np.array(c, int) for c in cols]), np.repeat(np.arange(len(cols)), [len(c) for c in cols]),
                     np.array(tags[1:-1]), -1 if tags[0] is None else tags[0], -1 if tags[-1] is None else tags[-1]))
    rnd = np.random.default_rng(7)
    for _ in range(epochs):
        order = rnd.permutation(len(data))
        for at in range(0, len(order), size):
            part = [data[i] for i in order[at:at + size]]
            k, n = len(part), max(len(d[2]) for d in part)
            cols = np.concatenate([d[0] for d in part])
            rows = np.concatenate([d[1] + i * n for i, d in enumerate(part)])
            length = np.array([len(d[2]) for d in part])
            tags = np.zeros((k, n), int)
            for i, d in enumerate(part):
                tags[i, :len(d[2])] = d[2]
            before, after = (np.array([d[j] for d in part]) for j in (3, 4))
            moves = crf.moves + FORBIDDEN
            entry = np.where((before < 0)[:, None], START, moves[before])
            exit_ = np.where((after < 0)[:, None], 0.0, moves.T[after])
            e = np.stack([np.bincount(rows, crf.weights[cols, y], k * n) for y in range(3)], axis=1).reshape(k, n, 3)
            f, b = np.zeros((n, k, 3)), np.zeros((n, k, 3))
            f[0], b[-1] = entry + e[:, 0], exit_
            for i in range(1, n):
                f[i] = np.where((i < length)[:, None], _log_sum(f[i - 1][:, :, None] + moves, 1) + e[:, i], f[i - 1])
            for i in range(n - 2, -1, -1):
                b[i] = np.where((i + 1 < length)[:, None], _log_sum(moves + (e[:, i + 1] + b[i + 1])[:, None, :], 2), exit_)
            z = _log_sum(f[-1] + exit_, 1)
            live = np.arange(n)[None] < length[:, None]
            p = np.exp(f + b - z[None, :, None]).transpose(1, 0, 2) * live[:, :, None]  # [sequence, place, tag]
            q = np.exp(f[:-1, :, :, None] + moves + (e.transpose(1, 0, 2)[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])
            g = (q * live.T[1:, :, None, None]).sum(axis=(0, 1))
            pairs = live[:, 1:]
            np.add.at(g, (tags[:, :-1][pairs], tags[:, 1:][pairs]), -1)
            p[live] -= np.eye(3)[tags[live]]  # expected minus observed
            np.add.at(g, before[before >= 0], p[before >= 0, 0])
            np.add.at(g.T, after[after >= 0], p[after >= 0, length[after >= 0] - 1])
            flat = p.reshape(-1, 3)
            gw = np.stack([np.bincount(cols, flat[rows, y], len(index)) for y in range(3)], axis=1) / k
            g = g / k
            seen_m += g * g
            crf.moves -= rate * (g / np.sqrt(seen_m) + ridge * crf.moves)
            hit = np.unique(cols)
            seen_w[hit] += gw[hit] ** 2
            crf.weights[hit] -= rate * (gw[hit] / np.sqrt(seen_w[hit]) + ridge * crf.weights[hit])
    return crf


def _values(base: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the base spans' values, overlapping ones as one."""
    merged: list[list[int]] = []
    for v, b in sorted((v, b) for _, _, b, v in base):
        if merged and v < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([v, b])
    return np.array([m[0] for m in merged], int), np.array([m[1] for m in merged], int)


def true_tags(t: Tokens, base: list[Span]) -> np.ndarray:
    """Tags of one text's tokens by its base spans."""
    starts, ends = _values(base)
    if not len(starts):
        return np.zeros(len(t.start), int)
    span = np.searchsorted(ends, t.start, side="right")  # first value that ends behind the token's start
    inside = (span < len(starts)) & (starts[np.minimum(span, len(starts) - 1)] < t.end)
    same = np.concatenate([[False], inside[1:] & inside[:-1] & (span[1:] == span[:-1])])
    return np.where(inside, np.where(same, 2, 1), 0)


WINDOW = "has int, key long, tokens array<string>, quoted array<boolean>, named array<int>, tags array<int>, facts array<string>"


def windows(text: str, limit: int, longest: int = 32) -> list[tuple]:
    """Training windows of a text as rows of ``WINDOW``: of those with a base span
    and of those without the ``limit`` with the smallest hash of their text. The tokens
    reach two before and one behind the window, the tags one on either side."""
    base = base_spans(text)
    t = tokenise([text])
    n = len(t.words)
    tags = true_tags(t, base)
    found: tuple[dict, dict] = ({}, {})
    for a in range(0, n, longest):
        b = min(n, a + longest)
        key = xxhash.xxh3_64_intdigest(text[t.start[a]:t.end[b - 1]].encode("utf-8", "surrogatepass")) >> 1
        found[bool(tags[a:b].any())].setdefault(key, (a, b))
    named = named_after(t, np.array([w in ("=", ":") for w in t.words], dtype=bool), np.array([is_name(w) for w in t.words], dtype=bool))
    words, ends = ["", "", *t.words, ""], [None, *tags.tolist(), None]
    return [(int(has), key, words[a:b + 3], t.quoted[a:b].tolist(), named[a:b].tolist(), ends[a:b + 2], file_facts(text))
            for has in (False, True) for key, (a, b) in sorted(found[has].items())[:limit]]


def sample(docs: DataFrame, sample_windows: int, per_document: int, sample_docs: int) -> list:
    """The windows with the smallest keys, ``sample_windows`` of either sort at most, of
    the documents with the smallest hashes (see the module's text). A wider round only
    reads the tokens of documents with a base span."""
    src = docs.select(text_or_empty("text").alias("text"))
    total = src.count()
    share = sample_docs / total if total else 1.0

    def collect(wider: bool):
        def run(batches):
            kept: tuple[dict, dict] = ({}, {})
            for b in batches:
                for text in b.column(0).to_pylist():
                    if wider and not base_spans(text):
                        continue
                    for row in windows(text, per_document):
                        if row[0] or not wider:
                            kept[row[0]][row[1]] = row
                for k in kept:
                    for key in sorted(k)[sample_windows:]:
                        del k[key]
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, row)) for k in kept for row in k.values()], schema=ARROW)
        return run

    def picked(share: float, wider: bool) -> list[list]:
        few = src if share >= 1 else src.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
        found = written(few.mapInArrow(collect(wider), WINDOW), "secret-windows")
        return [found.where(F.col("has") == has).dropDuplicates(["key"]).orderBy("key").limit(sample_windows).collect()
                for has in (0, 1)]

    without, having = picked(share, False)
    while len(having) < sample_windows and share < 1:
        share *= 8
        having = picked(share, True)[1]
    return without + having


FIELDS = ["has", "key", "tokens", "quoted", "named", "tags", "facts"]
ARROW = pa.schema(list(zip(FIELDS, [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()),
                                    pa.list_(pa.int32()), pa.list_(pa.string())])))


def learn(docs: DataFrame, sample_windows: int = 1000, per_document: int = 4, sample_docs: int = 20_000) -> Crf:
    """Train on at most ``sample_windows`` windows with a base span and as many without."""
    bound_batches(docs.sparkSession)
    rows = sample(docs, sample_windows, per_document, sample_docs)
    if not any(r.has for r in rows):
        return Crf()
    return train([([token_features(r.tokens, i + 2, r.quoted[i], r.named[i], r.facts, hide) for i in range(len(r.quoted))], r.tags)
                  for r in rows for hide in VIEWS])


def added(spans: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """CRF spans that touch no base span's value."""
    values = sorted((v, b) for _, _, b, v in base)
    starts, reach = [v for v, _ in values], list(accumulate((b for _, b in values), max))
    return [(a, 3, b, a) for a, b in spans if not ((k := bisect_left(starts, b)) and reach[k - 1] > a)]


def scanned(texts: Iterable[str], tagger: Tagger) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Every text with its base spans and all spans, by start, then kind; texts are
    tagged in groups of about ``GROUP_CHARS`` characters."""
    group: list[str] = []
    chars = 0

    def flush():
        for text, spans in zip(group, tagger.spans(group)):
            base = base_spans(text)
            yield text, base, sorted(base + added(spans, base))

    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield from flush()
            group, chars = [], 0
    yield from flush()


def spans_of(text: str, crf: Crf) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind."""
    return next(scanned([text], Tagger(crf)))[1:]


def scan(docs: DataFrame, crf: Crf) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans``."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tagger = Tagger(crf)
        for b in batches:
            n, sha, all_ = [[], [], [], []], [], []
            for _, base, every in scanned(b.column(1).to_pylist(), tagger):
                for k in range(4):
                    n[k].append(sum(s[1] == k for s in every))
                sha.append(hashlib.sha256(listing(base).encode()).hexdigest())
                all_.append(listing(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, pa.int64()) for c in n] + [pa.array(sha, pa.string()), pa.array(all_, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return src.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span], mark: str) -> str:
    """Text with every span's value replaced; overlapping spans as one."""
    out, at = [], 0
    for a, end in sorted((v, b) for _, _, b, v in spans):
        if end <= at:
            continue
        out += [text[at:max(a, at)], mark if a >= at else ""]
        at = end
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, crf: Crf, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets' values replaced in ``text`` (and ``n_chars``, where
    it is a column, set to the new length); every row stays."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        tagger = Tagger(crf)
        for b in batches:
            given = b.column(at).to_pylist()
            clean = (redact(t, every, mark) for t, _, every in scanned((t or "" for t in given), tagger))
            texts = [None if t is None else c for t, c in zip(given, clean)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return out.select(*docs.columns)
