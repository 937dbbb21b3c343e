"""Levenshtein automata run over a lexicon trie, as one lazily built machine.

A state is a set of (trie node, edits so far). Reading a letter moves along
the trie (no edit), or spends an edit on a replaced, added or left-out
letter; a state's moves are computed once and kept. An entry is a whole word
or a stem (any ending), with its own budget of edits; branches whose entries
cannot afford an edit drop out, so most words die after a few letters.
"""
from __future__ import annotations


class Lexicon:
    """``entries``: (text, is_stem, budget). ``match`` finds the nearest entry."""

    def __init__(self, entries: list[tuple[str, bool, int]], max_moves: int = 300_000):
        self.entries = list(entries)
        self.max_moves = max_moves
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # entry that ends at the node
        self.stem: list[int] = [-1]
        self.budget = [0]  # largest budget at or below the node
        for e, (text, is_stem, budget) in enumerate(self.entries):
            n = 0
            self.budget[0] = max(self.budget[0], budget)
            for ch in text:
                if ch not in self.child[n]:
                    self.child[n][ch] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.budget.append(0)
                n = self.child[n][ch]
                self.budget[n] = max(self.budget[n], budget)
            (self.stem if is_stem else self.word)[n] = e
        self._reset()

    def _reset(self) -> None:
        """Forget computed moves (they come back as they are needed)."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []  # best (edits, entry) if the word ends here
        self.stems: list[tuple[int, int] | None] = []  # best stem completed here
        self.count = 0
        self.start = self._state({(0, 0)})

    def _close(self, state: set) -> set:
        """Add what left-out letters reach, keep the fewest edits per node."""
        best: dict[int, int] = {}
        todo = sorted(state, key=lambda x: x[1])
        while todo:
            n, e = todo.pop(0)
            if e > self.budget[n] or best.get(n, 99) <= e:
                continue
            best[n] = e
            todo.extend((c, e + 1) for c in self.child[n].values())
        return set(best.items())

    def _state(self, raw: set) -> int:
        state = frozenset(self._close(raw))
        if not state:
            return -1
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ok = lambda e, at: at >= 0 and e <= self.entries[at][2]
            self.ends.append(min(((e, self.word[n]) for n, e in state if ok(e, self.word[n])), default=None))
            self.stems.append(min(((e, self.stem[n]) for n, e in state if ok(e, self.stem[n])), default=None))
        return self.ids[state]

    def _move(self, at: int, ch: str) -> int:
        raw = set()
        for n, e in self.states[at]:
            for c, m in self.child[n].items():
                raw.add((m, e if c == ch else e + 1))
            raw.add((n, e + 1))
        to = self.moves[at][ch] = self._state(raw)
        self.count += 1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry within its budget, or None."""
        if self.count > self.max_moves:
            self._reset()
        at, best = self.start, self.stems[self.start]
        for ch in word:
            to = self.moves[at].get(ch)
            at = self._move(at, ch) if to is None else to
            if at < 0:
                return best
            s = self.stems[at]
            if s is not None and (best is None or s < best):
                best = s
        end = self.ends[at]
        return end if end is not None and (best is None or end <= best) else best
