"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon holds words and stems that training labels tie to toxic
documents. Every distinct word of a text runs through the automaton
(:mod:`.automaton`), which also catches misspelled terms; near spellings that
clean training documents use are set aside. A hit's window tells abuse from
quotation: inside quotation marks or behind a reporting word it counts as
quoted, beside a second-person word as aimed. A logistic model over the counts
of the four kinds of hits, fitted on the sample's other half (on all of it where it
holds fewer than 400 toxic rows), gives the score.

Training reads a bounded sample of the labelled rows: at most ``sample_rows``
of either class, those with the smallest hash of their id; near copies (same
smallest hash of a five-word shingle) count once. Every word and stem of the
sample is tested and every one that passes is an entry; every harmless near
spelling is kept. Only the sample bounds them. Scoring reads every word of
every text.

Defined cases: null text counts as empty; labels with a null id or a value
other than 0 or 1 are ignored; without labels of both classes there is no
lexicon and the score is the smoothed share of label 1 (0.5 without any);
repeated rows keep one output row each; an empty table gives an empty table;
extra columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Lexicon
from .common import bound_batches, text_or_empty, written

# Words that report speech and words that address a reader.
REPORTING = frozenset("""said says called calls wrote writes quote quoted quotes cited replied
sagte sagt nannte schrieb zitat zitiert dit disait écrit cité appelle citation dijo dice llamó escribió cita citado
""".split())
ADDRESS = frozenset("you your youre u ur du dich dir dein deine ihr tu toi ton vous votre tú tu usted eres bist".split())
OPENING, CLOSING = "“«„‹", "”»“›"
LEET = str.maketrans("013457", "oieast")
MARKS = re.compile(f'["{OPENING}{CLOSING}]')
FIRST = re.compile(r"\s*(.?)", re.DOTALL)
WORD = re.compile(r"\w+")
KINDS = ["plain", "near", "quoted", "aimed"]
WINDOW = 5


def plain_word(w: str) -> str:
    """Digits read as the letters they stand for, where letters are beside them."""
    return w if w.isalpha() or w.isdigit() else w.translate(LEET)


@dataclass
class Model:
    """Lexicon entries, near spellings that are harmless, logistic weights."""
    entries: list[tuple[str, bool, int]] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (0.0,) * (len(KINDS) + 2)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.entries)

    def score(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -500, 500)))


def hits(text: str, lexicon: Lexicon, harmless: frozenset[str]) -> list[tuple[int, int, str, int, str]]:
    """(start, end, term, edits, kind) of every hit of a text in lower case."""
    words = set(WORD.findall(text))
    found = {}
    for w in words:
        m = lexicon.match(plain_word(w))
        if m is not None and (m[0] == 0 or w not in harmless):
            found[w] = m
    if not found:
        return []
    all_words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    at = [i for i, x in enumerate(all_words) if x[2] in found]
    out = []
    for i, cited in zip(at, quoted(text, [all_words[i][:2] for i in at])):
        a, b, w = all_words[i]
        edits, entry = found[w]
        before = [x[2] for x in all_words[max(0, i - WINDOW):i]]
        after = [x[2] for x in all_words[i + 1:i + 1 + WINDOW]]
        if cited or not REPORTING.isdisjoint(before):
            kind = "quoted"
        elif not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after):
            kind = "aimed"
        else:
            kind = "near" if edits else "plain"
        out.append((a, b, lexicon.entries[entry][0], edits, kind))
    return out


def quoted(text: str, spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each span (ascending, none over a line's end) lies in a
    quotation of its line: behind an opening mark that nothing closed and
    before a closing one, or in a line that starts with ``>``. One sweep over
    the marks of every line that holds a span."""
    out: list[bool] = []
    i = 0
    while i < len(spans):
        start = text.rfind("\n", 0, spans[i][0]) + 1
        end = text.find("\n", spans[i][1])
        end = end if end >= 0 else len(text)
        marks = [(m.start(), m.group()) for m in MARKS.finditer(text, start, end)]
        cited = FIRST.match(text, start, end).group(1) == ">"
        last = {c: max((p for p, m in marks if m in c), default=-1) for c in ('"', CLOSING)}
        straight, opened, closed, k = 0, -1, -1, 0
        while i < len(spans) and spans[i][0] < end:
            a = spans[i][0]
            while k < len(marks) and marks[k][0] < a:
                p, m = marks[k]
                straight += m == '"'
                opened = p if m in OPENING else opened
                closed = p if m in CLOSING else closed
                k += 1
            out.append(cited or (straight % 2 == 1 and last['"'] >= a)
                       or (opened >= 0 and closed <= opened and last[CLOSING] >= a))
            i += 1
    return out


def features(text: str, lexicon: Lexicon, harmless: frozenset[str]) -> list[float]:
    """log(1 + hits) of each kind, and the root of the share of words that are unquoted hits."""
    found = hits(text.lower(), lexicon, harmless)
    if not found:
        return [0.0] * (len(KINDS) + 1)
    n = Counter(h[4] for h in found)
    direct = len(found) - n["quoted"]
    return [math.log1p(n[k]) for k in KINDS] + [math.sqrt(direct / max(1, len(text.split())))]


def _signature(text: str) -> int:
    words = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int) -> DataFrame:
    """``text, y, half`` of the bounded labelled sample, near copies once."""
    good = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        "doc_id", F.col("toxic").cast("int").alias("y"))
    ids = [good.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(
        F.broadcast(chosen), "doc_id")  # at most 2 x sample_rows ids

    def sign(batches):
        for b in batches:
            sig = [_signature(t) & 0x7FFFFFFFFFFFFFFF for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.int64())],
                                             names=["text", "y", "sig"])

    signed = written(rows.select("text", "y").mapInArrow(sign, "text string, y int, sig long"), "toxic-sample")
    return signed.dropDuplicates(["sig", "y"]).withColumn("half", F.pmod(F.xxhash64("sig"), F.lit(2)).cast("int"))


def _word_counts(sample: DataFrame) -> DataFrame:
    """``word, t, c``: toxic and clean documents of the sample that hold a word."""

    def count(batches):
        got = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[y].update({plain_word(w) for w in WORD.findall(text.lower())})
            if len(got[0]) + len(got[1]) > 500_000:  # bounded memory: partial counts add up later
                yield from flush(got)
                got = (Counter(), Counter())
        yield from flush(got)

    def flush(got):
        words = list(got[0].keys() | got[1].keys())
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([got[1][w] for w in part], pa.int64()),
                 pa.array([got[0][w] for w in part], pa.int64())], names=["word", "t", "c"])

    return sample.select("text", "y").mapInArrow(count, "word string, t long, c long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"))


def evidence(t: float, c: float, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a word being tied to toxic documents: 0 where
    its share of toxic documents is no more than the sample's."""
    n, p = t + c, toxic / (toxic + clean)
    if t <= n * p:
        return 0.0
    return t * math.log(t / (n * p)) + (c * math.log(c / (n * (1 - p))) if c else 0.0)


def _may_be_tied(toxic: int, clean: int, min_odds: float = 3.0, min_evidence: float = 16.0) -> Column:
    """``choose_entries``' test over columns ``t`` and ``c``, a hair wider (its last digits are decided there)."""
    if not toxic or not clean:  # evidence is 0 then
        return F.lit(False)
    n, p = F.col("t") + F.col("c"), toxic / (toxic + clean)
    odds = F.log((F.col("t") + .5) / (toxic + 1)) - F.log((F.col("c") + .5) / (clean + 1))
    ratio = F.col("t") * F.log(F.col("t") / (n * p)) + F.when(
        F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - p)))).otherwise(0.0)
    return (F.col("t") > 0) & (odds >= min_odds - 1e-6) & (ratio >= min_evidence - 1e-6)


def choose_entries(words: list[tuple[str, int, int]], stems: list[tuple[str, int, int, int, int]],
                   toxic: int, clean: int, min_odds: float = 3.0, min_evidence: float = 16.0
                   ) -> list[tuple[str, bool, int]]:
    """Entries from (word, t, c) and (stem, t, c, largest t of a word, words).

    A stem stands for a family of words; one that a single word makes up is
    left to that word. ``min_evidence`` 16 lets about one of ten million
    unrelated words through. Budgets: words of 5 letters one edit, of 8 two;
    stems of 6 letters one.
    """
    def tied(t: int, c: int) -> bool:
        odds = math.log((t + .5) / (toxic + 1)) - math.log((c + .5) / (clean + 1))
        return odds >= min_odds and evidence(t, c, toxic, clean) >= min_evidence

    kept: set[str] = set()

    def within(w: str) -> bool:
        return any(w[:k] in kept for k in range(1, len(w) + 1))

    for s, t, c, top, n in sorted(stems, key=lambda r: (len(r[0]), r[0])):
        if n >= 3 and top < 0.8 * t and tied(t, c) and not within(s):
            kept.add(s)
    out = [(s, True, 1 if len(s) >= 6 else 0) for s in sorted(kept, key=lambda s: (len(s), s))]
    for w, t, c in sorted(words):
        if len(w) >= 3 and tied(t, c) and not within(w):
            out.append((w, False, 2 if len(w) >= 8 else 1 if len(w) >= 5 else 0))
    return out


def trusted(entries: list[tuple[str, bool, int]], near: list[tuple[int, int, int, int]],
            toxic: int, clean: int) -> list[tuple[str, bool, int]]:
    """Entries with the budget cut below the first number of edits whose near
    spellings, (entry, edits, t, c) over the sample, are mostly other words."""
    budget = [e[2] for e in entries]
    for i, edits, t, c in near:
        if t / max(1, toxic) < 3 * c / max(1, clean):
            budget[i] = min(budget[i], edits - 1)
    return [(w, stem, k) for (w, stem, _), k in zip(entries, budget)]


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 10_000) -> Model:
    """Lexicon and weights from the training labels (see the module)."""
    bound_batches(docs.sparkSession)
    sample = written(_sample(docs, labels, train, sample_rows), "toxic-distinct")
    n = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    total = [n.get((0, y), 0) + n.get((1, y), 0) for y in (0, 1)]
    prior = math.log((total[1] + 1) / (total[0] + 1))
    if min(total) == 0:
        return Model(weights=(prior,) + (0.0,) * (len(KINDS) + 1))
    if total[1] < 400:  # too few toxic rows to halve: lexicon and weights share the sample
        sample = sample.withColumn("half", F.lit(0))
        n = {(0, y): total[y] for y in (0, 1)}
    counts = written(_word_counts(sample.where("half = 0")), "toxic-words")
    size = n.get((0, 1), 0), n.get((0, 0), 0)
    words = counts.where(_may_be_tied(*size))
    stems = counts.where("t >= 1 OR c >= 1").select(
        "t", "c", F.length("word").alias("len"), "word", F.explode(F.array(*[F.lit(k) for k in (4, 5, 6, 7)])).alias("k"))
    stems = stems.where("len > k").groupBy(F.substring("word", F.lit(1), F.col("k")).alias("stem")).agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), F.max("t").alias("top"), F.sum(F.expr("int(t > 0)")).alias("n"))
    stems = stems.where((F.col("n") >= 3) & _may_be_tied(*size))
    entries = choose_entries([tuple(r) for r in words.collect()], [tuple(r) for r in stems.collect()], *size)

    def near(batches):
        lexicon = Lexicon(entries)
        for b in batches:
            m = [lexicon.match(w) or (0, -1) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([e for _, e in m], pa.int32()), pa.array([d for d, _ in m], pa.int32())],
                names=[*b.schema.names, "entry", "edits"]).filter(pa.array([d > 0 for d, _ in m]))

    spelled = written(counts.mapInArrow(near, "word string, t long, c long, entry int, edits int"), "toxic-near")
    # One row per entry and number of edits: at most twice the entries.
    sums = spelled.groupBy("entry", "edits").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    entries = trusted(entries, [tuple(r) for r in sums], *size)
    # Near spellings in clean documents at least as often, per document, as in toxic ones.
    rate = size[0] / max(1, size[1])
    used = spelled.where((F.col("c") >= 1) & (F.col("t") <= rate * F.col("c"))).select("word")
    harmless = frozenset(r.word for r in used.collect())
    fitted = Model(entries, harmless)

    def measure(batches):
        lexicon = fitted.lexicon()
        for b in batches:
            x = [features(t, lexicon, harmless) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    other = sample.where("half = 1") if n.get((1, 1), 0) else sample
    rows = other.select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    fitted.weights = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    return fitted


# Weights before any label is seen (intercept, KINDS, share): a kind of hit the
# sample lacks keeps its own.
PRIOR = (-3.0, 3.0, 3.0, 0.0, 3.0, 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Intercept and weights by Newton steps, drawn to ``PRIOR``; hits never lower a score."""
    full = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array(PRIOR)
    free = np.ones(full.shape[1], dtype=bool)
    while True:
        z, v = full[:, free], prior[free].copy()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(hess, z.T @ (p - y) + ridge * (v - prior[free]))
            v -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        w = np.zeros(full.shape[1])
        w[free] = v
        down = (w < 0) & (np.arange(len(w)) > 0)
        if not down.any():
            return tuple(map(float, w))
        free &= ~down


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted``, ``n_hits`` per row."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lexicon = model.lexicon()
        for b in batches:
            x = np.array([features(t, lexicon, model.harmless) for t in b.column(1).to_pylist()]).reshape(
                b.num_rows, len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def found_terms(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, end, term, edits, kind`` per hit (code points of the lower-cased text)."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lexicon = model.lexicon()
        for b in batches:
            at, cols = [], [[], [], [], [], []]
            for i, t in enumerate(b.column(1).to_pylist()):
                for h in hits(t.lower(), lexicon, model.harmless):
                    at.append(i)
                    for c, v in zip(cols, h):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "start", "end", "term", "edits", "kind"])

    return src.mapInArrow(run, f"doc_id {kind}, start long, end long, term string, edits long, kind string")


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, columns as given; no text is shuffled."""
    model = learn(docs, labels, train)
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        lexicon = model.lexicon()
        for b in batches:
            x = np.array([features(t or "", lexicon, model.harmless) for t in b.column(at).to_pylist()]).reshape(
                b.num_rows, len(KINDS) + 1)
            yield b.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
