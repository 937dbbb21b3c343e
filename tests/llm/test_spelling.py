import random
import re
import zlib
from collections import Counter, defaultdict

from courtside.llm import spelling
from courtside.llm.common import written

SCHEMA = "doc_id long, text string, n long, word string"


def brute(rows, thin=97, min_symbols=5, min_count=3):
    """The contract as stated: all runs one by one, all pairs of words."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % thin == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= min_symbols and k >= min_count}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda u: (-n[u], u))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA)


def test_against_all_pairs(llm_spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "ababababa", "éÉéÉé", "÷÷÷×÷", "ÿÿÿÿÿÿ"]
    weights = [2.0 ** rnd.randint(0, 9) for _ in stems]
    rows = [(i if i % 50 else None, " ".join(rnd.choices(stems, weights, k=40)) + ". Aaaaa,AAAAAÉ_x1y") for i in range(300)]
    # A chain of forms: each at least twice as frequent as the one before.
    rows += [(i, "chaina " * (1 + i % 2) + "chainab " * 4 + "chainabc " * 9) for i in range(1000, 1010)]
    rows += [(1, None), (2, ""), (3, "1 2 3 ߀"), *[rows[0]] * 3]
    for thin in (97, 2):
        want = brute(rows, thin)
        assert got(spelling.variants(frame(llm_spark, rows), thin=thin)) == want
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 5 and any(w[1] not in (None, w[2]) for w in want)


def test_long_words_and_small_frontiers(llm_spark):
    """Words around and beyond the levels, with a shuffled frontier and split nodes."""
    rnd = random.Random(6)
    base = ["".join(rnd.choice("ab") for _ in range(k)) for k in (5, 6, 7, 8, 9, 12) for _ in range(6)] + ["a" * 7, "a" * 8, "a" * 9]
    words = set(base)
    for w in base:
        for _ in range(6):
            p = rnd.randrange(len(w))
            words |= {w[:p] + w[p + 1:], w[:p] + rnd.choice("abc") + w[p + 1:], w[:p] + rnd.choice("abc") + w[p:]}
    rows = [(i, " ".join(sorted(words))) for i in range(3)]
    want = brute(rows)
    assert got(spelling.variants(frame(llm_spark, rows), levels=7)) == want
    table = written(spelling.vocabulary(frame(llm_spark, rows)), "words")
    pairs = {(r.a, r.b) for r in spelling.neighbours(table, small=0).collect()}
    assert len(pairs) == sum(w[4] for w in want) // 2 and all(one_edit(a, b) and a < b for a, b in pairs)
    rows2 = spelling.prefixes(table)
    edges = spelling.edges(rows2)
    one = spelling.first_edits(rows2, edges, 64, 10 ** 9)
    split = spelling.first_edits(rows2, edges, 64, 3)
    assert one.count() == split.count() and one.exceptAll(split).count() == 0


def test_very_long_runs(llm_spark):
    word = "ab" * 20_000
    rows = [(i, f"{word} {word[:-1]} {word[:9]}x{word[10:]}") for i in range(5)]
    out = {(len(w), "x" in w): (n, near) for w, _, _, n, near, _ in got(spelling.variants(frame(llm_spark, rows), thin=10 ** 12))}
    assert out == {(40_000, False): (5, 2), (39_999, False): (5, 1), (40_000, True): (5, 1)}


def test_empty(llm_spark):
    for rows in ([], [(1, None)], [(None, "aaaaa bbbbb")]):
        df = spelling.variants(frame(llm_spark, rows))
        assert df.count() == 0 and df.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_whole_table(llm_spark):
    """The registered query on sf0.001: counts and neighbours by left-out symbols."""
    from courtside.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = llm_spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op11_spelling_variants"](llm_spark, sf)) == brute([tuple(r) for r in docs])


def test_no_join_is_broadcast_by_its_estimate(llm_spark):
    """A trie's rows are many times its words' files: only the two joins that are counted first are broadcast."""
    words = written(llm_spark.createDataFrame([(f"word{i:04d}",) for i in range(300)], "word string"), "test-words")
    rows = spelling.prefixes(words)
    table = written(spelling.edges(rows), "test-edges")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    first = spelling.first_edits(rows, table, 64, 2000)
    assert plan(first).count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan(first)
    assert "BroadcastHashJoin" not in plan(spelling.advance(first, table)).replace(plan(first), "").split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" in plan(spelling.advance(written(first, "test-front"), table, few=True))
    assert "BroadcastHashJoin" not in plan(spelling.neighbours(words)).replace("Scan", "")
