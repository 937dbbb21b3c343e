import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import quality, toxicity
from courtside.llm.automaton import Lexicon
from courtside.llm.common import table
from courtside.llm.queries import QUERIES, quality_train

DOCS = "doc_id long, text string, score double, y int"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    for v in np.unique(score):  # mean rank of ties
        at = score[order] == v
        rank[order[at]] = np.nonzero(at)[0].mean() + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name,mod,held,label", [("op6_quality", 3, 1, "quality"), ("op7_toxicity", 5, 0, "toxic")])
def test_held_out_rows(llm_spark, name, mod, held, label):
    out = QUERIES[name](llm_spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.toPandas()
    assert sorted(rows.doc_id) == list(range(1000)) and rows.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows.itertuples())
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    both = rows.merge(table(llm_spark, SF, "labels").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert area(both.score.to_numpy(), both[label].to_numpy()) > 0.97
    assert (both.predicted == both[label]).mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(llm_spark):
    docs, labels = table(llm_spark, SF, "documents"), table(llm_spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality_train(), F.col("quality")).otherwise(1 - F.col("quality")))
    a = quality.classify(docs, labels, quality_train()).orderBy("doc_id").collect()
    b = quality.classify(docs, turned, quality_train()).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in a], [r.score for r in b])


def test_discriminant_against_plain_formulas():
    rnd = np.random.default_rng(0)
    d = quality.D
    x = {c: rnd.normal(size=(300, d)) @ rnd.normal(size=(d, d)) + c for c in (0, 1)}
    m = quality.fit({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, 0.2, 0.02)
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / 600
    want = []
    for c in (0, 1):
        own = np.cov(x[c].T, bias=True)
        cov = 0.98 * (0.8 * own + 0.2 * pooled) + 0.02 * np.eye(d) * np.trace(pooled) / d
        z = x[0] - x[c].mean(0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.margin(x[0]), want[1] - want[0])


def test_quality_cases(llm_spark):
    rows = [(i, t, 0.5, 9) for i, t in enumerate(["", None, "a", "x " * 50_000, "!!!", " \n"])] + [(None, "t", 0.1, 1)] * 2
    docs = llm_spark.createDataFrame(rows, DOCS)
    none = llm_spark.createDataFrame([], LABELS)
    out = quality.classify(docs, none, F.lit(True)).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {1}
    one = llm_spark.createDataFrame([(0, 1, 0), (2, 1, None), (None, 0, 1), (3, None, 1), (4, 7, 3), (77, 0, 0)], LABELS)
    assert {round(r.score, 6) for r in quality.classify(docs, one, F.lit(True)).collect()} == {0.75}
    two = llm_spark.createDataFrame([(2, 1, 0), (3, 1, 1), (4, 0, 0), (5, 0, 0), (0, 0, 0)], LABELS)
    out = quality.classify(docs, two, F.lit(True)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(docs, two, F.lit(True))
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert quality.classify(docs.limit(0), two, F.lit(True)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    import random
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    entries = [(w, i % 4 == 0, i % 3) for i, w in enumerate(sorted(set(words[:25])))]
    for moves in (300_000, 5):  # 5: the machine forgets and rebuilds
        lexicon = Lexicon(entries, max_moves=moves)
        for w in words + ["", "zzz", "abcabcabcabcabc"]:
            best = []
            for e, (text, stem, budget) in enumerate(entries):
                d = min(edit_distance(text, w[:i]) for i in range(len(w) + 1)) if stem else edit_distance(text, w)
                if d <= budget:
                    best.append(d)
            got = lexicon.match(w)
            assert (got and got[0]) == (min(best) if best else None), (w, got, best)


def test_contexts_of_hits():
    lexicon = Lexicon([("idiot", False, 1), ("worthless", False, 2)])
    kinds = lambda t: [(h[2], h[3], h[4]) for h in toxicity.hits(t, lexicon, frozenset())]
    assert kinds("the idiot went") == [("idiot", 0, "plain")]
    assert kinds("the idiott and id1ot went") == [("idiot", 1, "near"), ("idiot", 0, "plain")]
    assert kinds('it said "the idiot went" here') == [("idiot", 0, "quoted")]
    assert kinds("> the idiot went\nwrthles stuff") == [("idiot", 0, "quoted"), ("worthless", 2, "near")]
    assert kinds("«un idiot» and then idiot") == [("idiot", 0, "quoted"), ("idiot", 0, "plain")]
    assert kinds("are you an idiot now") == [("idiot", 0, "aimed")]
    assert toxicity.hits("the idiott", lexicon, frozenset(["idiott"])) == []


def quoted_plainly(text, a, b):
    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    line, at = text[start:end if end >= 0 else len(text)], a - start
    if line.lstrip().startswith(">") or (line.count('"', 0, at) % 2 and '"' in line[at:]):
        return True
    opened = max(line.rfind(c, 0, at) for c in toxicity.OPENING)
    return opened >= 0 and max(line.rfind(c, opened + 1, at) for c in toxicity.CLOSING) < 0 and any(
        c in line[at:] for c in toxicity.CLOSING)


def test_quotations_against_plain_rule():
    rnd = np.random.default_rng(3)
    signs = ["wort", "x", " ", " ", "\n", '"', ">", "“", "”", "«", "»", "„", "‹", "›", "\t"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs, size=rnd.integers(1, 40)))
        spans = [m.span() for m in toxicity.WORD.finditer(text)]
        assert toxicity.quoted(text, spans) == [quoted_plainly(text, a, b) for a, b in spans], text


def test_time_of_one_long_line_is_linear():
    def seconds(n):
        text = 'say "scum" and “scum then ' * n
        spans = [m.span() for m in toxicity.WORD.finditer(text) if m.group() == "scum"]
        begin = time.perf_counter()
        assert len(toxicity.quoted(text, spans)) == 2 * n
        return time.perf_counter() - begin

    assert min(seconds(40_000) for _ in range(3)) < 40 * min(seconds(2_500) for _ in range(3))


def test_toxicity_cases(llm_spark):
    texts = ["", None, "you worthless idiot", "fine words here", "x " * 50_000, "worthless idiots, you are idiot"]
    docs = llm_spark.createDataFrame([(i, t, 0.5, 9) for i, t in enumerate(texts)] + [(None, "t", 0.1, 1)] * 2, DOCS)
    none = llm_spark.createDataFrame([], LABELS)
    m = toxicity.learn(docs, none, F.lit(True))
    assert m.entries == [] and {r.score for r in toxicity.scored(docs, m).collect()} == {0.5}
    # Every toxic row has one of two words, copies of one text count once.
    many = [(1000 + i, f"line {i} thing {i * 3} blorked {i * 5} of words {i}", 0.0, 0) for i in range(40)]
    many += [(2000 + i, f"line {i} thing {i * 3} calm {i * 5} of words {i}", 0.0, 0) for i in range(200)]
    many += [(3000 + i, "one copied text with rareword inside it", 0.0, 0) for i in range(60)]
    d2 = llm_spark.createDataFrame(many, DOCS)
    labels = llm_spark.createDataFrame([(r[0], 1, int(r[0] < 2000 or r[0] >= 3000)) for r in many], LABELS)
    m = toxicity.learn(d2, labels, F.lit(True))
    assert ("blorked", False, 1) in m.entries and not any("rareword" in e[0] for e in m.entries)
    got = {r.doc_id: r.predicted for r in toxicity.scored(llm_spark.createDataFrame(
        [(1, "so blorked it is blorked", 0.0, 0), (2, "calm words", 0.0, 0), (3, "very blorkde blorkedd blorked", 0.0, 0)], DOCS), m).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    terms = toxicity.found_terms(d2.where("doc_id = 1000"), m).collect()
    assert [(t.term, t.edits) for t in terms] == [("blorked", 0)]
    kept = toxicity.drop_toxic(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and toxicity.scored(docs.limit(0), m).count() == 0



def test_lexicon_has_every_word_that_passes(llm_spark):
    """10,100 common words, 2,100 toxic words in fewer documents, and 10,200 harmless spellings of one of them."""
    from itertools import combinations, islice, product
    letters = "abcdefghijklmnopqrstuvwxyz"
    four = ["".join(w) for w in islice(product(letters[:20], letters[:20], letters[:20], "bdf"), 24_000)]
    common, toxic = four[:10_100], four[10_100:12_200]
    near = [w for a, b in combinations(range(10), 2) for x, y in product(letters, letters)
            for w in ["abominable"[:a] + x + "abominable"[a + 1:b] + y + "abominable"[b + 1:]] if w[a] != "abominable"[a]
            and w[b] != "abominable"[b]][:10_200]
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(90):
        words = common + ([] if i % 2 else near) + (toxic + ["abominable"] if i % 2 and i < 80 else [])
        rows.append((i, " ".join(rnd.permutation(words)), 0.0, 0))
    docs = llm_spark.createDataFrame(rows, DOCS).repartition(4)
    labels = llm_spark.createDataFrame([(i, 1, i % 2) for i in range(90)], LABELS)
    m = toxicity.learn(docs, labels, F.lit(True))
    assert {e[0] for e in m.entries} == {*toxic, "abominable"} and len(m.entries) == 2_101
    assert m.harmless >= set(near) and len(near) == 10_200
