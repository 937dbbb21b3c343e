"""Spelling variants: words one edit apart, found by a relational trie frontier.

The vocabulary becomes two tries, one of the words and one of the reversed
words, kept as distributed edge tables (node, symbol -> child); a node's id is
the hash of its prefix. A state is (word, position, node, edits). States
without an edit are the word's own prefixes, so all of them are known at once;
they meet the edge table on their node and leave it with one edit (another
symbol replaced, or one inserted). From there the states of all words move
one level at a time: a join of the frontier with the edge table on (node,
symbol at the position). A state that has read its whole word on a node that
ends a word is a neighbour. Deletions are insertions seen from the other word.

An edit in the second half of a word is made in the first trie, one in the
first half in the reversed trie, so an edit is only tried below a long exact
prefix, where few branches remain. Edges carry the lengths of the words and
the symbols that follow below them (64-bit masks), which drop a state before
it is shuffled; masks and ids may let a wrong state through, so every pair is
verified by its edit distance.

Words of more than ``levels`` symbols would need as many rounds. They are
joined on the hash of themselves without one symbol, all positions at once
(:func:`_long_pairs`): the same pairs, exactly.

Defined cases: a null text has no words; a null doc_id counts as empty text in
the hash; a repeated row counts again; no words (or an empty table) give an
empty table; extra columns are ignored; a run of any length is one word.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shuffled, text_or_empty, written

RUN = re.compile("[a-zÀ-ÿ]+")
PRIME = (1 << 61) - 1  # modulus of the rolling hash of long words
BASE = 1_000_003


def runs(doc_id: object, text: str, thin: int) -> Counter:
    """Runs of a whole text, A-Z lower-cased; where ``thin`` divides the crc32 h of
    ``<doc_id>:<run>``, the run loses its symbol h % length."""
    out: Counter = Counter()
    # Lower-casing bytes changes A-Z only.
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, k in Counter(RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), head)
        if h % thin == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += k
    return out


def vocabulary(docs: DataFrame, thin: int = 97, min_symbols: int = 5, min_count: int = 3) -> DataFrame:
    """``(word, n)`` of all documents. A task adds up its counts and hands them on
    whenever it holds 300,000 words; the shuffle sees a word once per task then."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))

    def count(batches):
        held: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return got

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, k in runs(i, t, thin).items():
                    if len(word) >= min_symbols:
                        held[word] += k
                if len(held) > 300_000:
                    yield flush()
        yield flush()

    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_count)


def _bit(code: Column) -> Column:
    """Bit of a symbol in a mask of following symbols; bit 63: a word ends here (code 0)."""
    return F.when(code == 0, F.lit(63)).otherwise(F.pmod(code, F.lit(63)))


def _symbol(text: str, at: Column) -> Column:
    """Code of the symbol at a position from 0; 0 at the end."""
    return F.ascii(F.substring(F.col(text), at + 1, F.lit(1)))


def _has(mask: str, bit: Column) -> Column:
    return F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0


def prefixes(words: DataFrame) -> DataFrame:
    """Every prefix of every word, in both directions: ``side, s, len, pos, node,
    ch, child, nxt`` (s: the word as read from that side; ch, child: the symbol behind
    the prefix and the prefix with it, 0 and null at the end; nxt: the symbol after that)."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")),
                              F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"))))
    d = words.select(sides.alias("x")).select("x.side", "x.s", F.length("x.s").alias("len"))
    node = F.transform(F.sequence(F.lit(0), F.col("len")), lambda p: F.xxhash64("side", F.substring("s", F.lit(1), p)))
    d = d.select("*", node.alias("nodes")).select("side", "s", "len", "nodes", F.posexplode("nodes").alias("pos", "node"))
    return d.select("side", "s", "len", "pos", "node", _symbol("s", F.col("pos")).alias("ch"),
                    F.get("nodes", F.col("pos") + 1).alias("child"), _symbol("s", F.col("pos") + 1).alias("nxt"))


def edges(rows: DataFrame) -> DataFrame:
    """The tries' edges: ``node, ch, child``, masks of word lengths (``lens``) and of
    following symbols (``nexts``) below the child."""
    one = F.lit(1).cast("long")
    return rows.where("child IS NOT NULL").groupBy("node", "ch").agg(
        F.max("child").alias("child"),
        F.bit_or(F.call_function("shiftleft", one, F.col("len") - 1)).alias("lens"),
        F.bit_or(F.call_function("shiftleft", one, _bit(F.col("nxt")))).alias("nexts"))


def _open(tlen: Column, need: Column) -> Column:
    """May words of ``tlen`` symbols lie below the edge, with symbol ``need`` next?"""
    return _has("lens", tlen - 1) & _has("nexts", _bit(need))


STATE = ["side", "s", "len", "tlen", "pos", "node"]


def first_edits(rows: DataFrame, table: DataFrame, levels: int, most: int) -> DataFrame:
    """States with one edit, from the prefixes of at least half a word.

    A node that more than ``most`` prefixes meet is split: its edges are
    repeated once per part, the states dealt to the parts by their word.
    """
    half = F.floor(F.col("len") / 2).cast("int")
    lo = F.when(F.col("side") == 0, half).otherwise(F.col("len") - half)
    states = rows.withColumn("lo", lo).where("pos >= lo")
    # At most (prefixes / most) nodes; ``most`` grows with the prefixes, see neighbours().
    hot = F.broadcast(states.groupBy("node").count().where(F.col("count") > most).select(
        "node", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    left = states.join(hot, "node", "left").withColumn("part", F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")
    right = table.join(hot, "node", "left").withColumn("part", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    right = right.select("node", "part", F.col("ch").alias("other"), F.col("child").alias("to"), "lens", "nexts")
    d = left.join(shuffled(right), ["node", "part"]).where("other <> ch")
    # Inserting a symbol before its like is the same word as behind it: tried only where the next one differs.
    # Of a replaced pair either word finds the other; the smaller symbol looks.
    put = F.struct((F.col("len") + 1).alias("tlen"), F.col("pos").alias("pos"),
                   (((F.col("side") == 0) | (F.col("pos") > F.col("lo"))) & (F.col("len") < levels)
                    & _open(F.col("len") + 1, F.col("ch"))).alias("ok"))
    swap = F.struct(F.col("len").alias("tlen"), (F.col("pos") + 1).alias("pos"),
                    ((F.col("ch") > 0) & (F.col("other") > F.col("ch")) & _open(F.col("len"), F.col("nxt"))).alias("ok"))
    d = d.select("side", "s", "len", "to", F.explode(F.filter(F.array(put, swap), lambda x: x["ok"])).alias("x"))
    return d.select("side", "s", "len", "x.tlen", "x.pos", F.col("to").alias("node"))


def advance(states: DataFrame, table: DataFrame, few: bool = False) -> DataFrame:
    """Open states read their next symbol along the edge table; ``few`` of them are broadcast."""
    d = states.withColumn("ch", _symbol("s", F.col("pos")))
    d = (F.broadcast(d) if few else shuffled(d)).join(table, ["node", "ch"]).withColumn("pos", F.col("pos") + 1)
    return d.where(_open(F.col("tlen"), _symbol("s", F.col("pos")))).select(
        "side", "s", "len", "tlen", "pos", F.col("child").alias("node"))


def _rolling(word: str) -> tuple[int, list[int]]:
    """Hash of the word, and of the word without the symbol at each position."""
    pre, power = [0], [1]
    for c in word:
        pre.append((pre[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    n, full = len(word), pre[-1]
    out = []
    for p in range(n):
        tail = (full - pre[p + 1] * power[n - p - 1]) % PRIME
        out.append((pre[p] * power[n - p - 1] + tail) % PRIME)
    return full, out


def _long_pairs(words: DataFrame, levels: int) -> DataFrame:
    """Pairs ``(a, b)`` of candidates of which one has more than ``levels`` symbols: equal
    once one symbol is left out at the same position, or one without a
    symbol equal to the other. Groups are small: the words that agree everywhere but at
    one position differ in that symbol."""
    src = words.where(F.length("word") >= levels).select("word")
    schema = "id long, len int, p int, key long"

    def less(batches):
        for b in batches:
            for w in b.column(0).to_pylist():
                full, without = _rolling(w)
                ident = zlib.crc32(w.encode()) << 30 ^ full
                rows = [(-1, full)] + (list(enumerate(without)) if len(w) > levels else [])
                for i in range(0, len(rows), 100_000):
                    part = rows[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident] * len(part), pa.int64()), pa.array([len(w)] * len(part), pa.int32()),
                         pa.array([p for p, _ in part], pa.int32()), pa.array([k for _, k in part], pa.int64())],
                        names=["id", "len", "p", "key"])

    rows = written(src.mapInArrow(less, schema), "spelling-long")
    whole, cut = rows.where("p < 0"), rows.where("p >= 0")
    b = cut.select(F.col("id").alias("other"), "len", "p", "key")
    swaps = cut.join(shuffled(b), ["len", "p", "key"]).where("id < other").select("id", "other")
    puts = cut.select("id", "len", "key").distinct().join(
        shuffled(whole.select(F.col("id").alias("other"), (F.col("len") + 1).alias("len"), "key")), ["len", "key"]).select("id", "other")
    # The ids are those of the words' own rows, made the same way.
    names = _named(words.where(F.length("word") >= levels))
    return (swaps.unionByName(puts).distinct()
            .join(shuffled(names.select("id", F.col("word").alias("a"))), "id")
            .join(shuffled(names.select(F.col("id").alias("other"), F.col("word").alias("b"))), "other").select("a", "b"))


def _named(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            text = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.crc32(w.encode()) << 30 ^ _rolling(w)[0] for w in text], pa.int64()), b.column(0)],
                names=["id", "word"])

    return words.select("word").mapInArrow(run, "id long, word string")


def neighbours(words: DataFrame, levels: int = 64, small: int = 100_000) -> DataFrame:
    """Pairs ``(a, b)`` of different words one edit apart, each pair once.

    ``words`` is a written table. A frontier of at most ``small`` states (words
    of at most ``levels`` symbols) is broadcast, a larger one shuffled; nothing is
    broadcast by an estimate.
    """
    rows = prefixes(words.where(F.length("word") <= levels))
    table = written(edges(rows), "spelling-edges")
    most = max(2_000, rows.count() // 50_000)
    level = written(first_edits(rows, table, levels, most), "spelling-frontier")
    found = level.where("pos = len")
    while (n := level.where("pos < len").count()) > 0:
        front = level.where("pos < len")
        level = written(advance(front, table, few=n <= small), "spelling-frontier")
        found = found.unionByName(level.where("pos = len"))
    ends = rows.where("pos = len").select("node", F.col("s").alias("near"))
    d = found.join(shuffled(ends), "node").where(F.levenshtein("s", "near", 1) == 1)
    turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = d.select(turned("s").alias("a"), turned("near").alias("b"))
    if words.where(F.length("word") > levels).limit(1).count():
        pairs = pairs.unionByName(_long_pairs(words, levels).where(F.levenshtein("a", "b", 1) == 1))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` -> ``(word, root)``: forms followed to the last by pointer
    doubling. A form occurs at least twice as often as its word, so there is no cycle and
    the rounds grow with the logarithm of the longest chain."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(shuffled(step), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, thin: int = 97, min_symbols: int = 5, min_count: int = 3, ratio: int = 2,
             levels: int = 64) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    A word's form is its neighbour of largest n (ties: the smallest word), if that n is
    at least ``ratio`` times its own.
    """
    words = written(vocabulary(docs, thin, min_symbols, min_count), "spelling-words")
    pairs = written(neighbours(words, levels), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = both.join(shuffled(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    d = words.join(shuffled(best), "word", "left")
    taken = -F.col("best.less") >= ratio * F.col("n")
    d = written(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(taken, F.col("best.near")).alias("form"),
                         F.when(taken, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(d.where("form IS NOT NULL").select("word", "form"))
    return d.join(shuffled(last), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
