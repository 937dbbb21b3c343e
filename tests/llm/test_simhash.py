import re

import pytest
import xxhash

from courtside.llm import components, simhash

SCHEMA = "doc_id long, text string, component_id string, fp int"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    up = dict.fromkeys(fps)
    for i in up:
        up[i] = i

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = list(fps)
    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


TEXTS = ["", None, "  \t\n", "one", "ONE", "one two", "É é A", "a b c d", "the same words again and again " * 40,
         "the same words again and again " * 40 + "x", "The Same words again and again " * 40, "long " * 30_000]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint_bytes((t or "").encode()) == brute_fp(t or "")


def test_near_duplicates_against_brute_force(llm_spark):
    base = [f"w{i} x{i % 5} y{i * 7 % 11}" for i in range(60)]
    texts = TEXTS + [" ".join(base + [f"tail{k}"] * (k % 4)) for k in range(40)] + [f"other {k} text {k * k} here" for k in range(40)]
    rows = [(100 + i, t, "clash", 1) for i, t in enumerate(texts)]
    out = simhash.near_duplicates(llm_spark.createDataFrame(rows + rows[:3], SCHEMA)).collect()
    fps = {i: brute_fp(t or "") for i, t, *_ in rows}
    assert len(out) == len(rows) + 3
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in out} == brute_components(fps, 2)
    kept = simhash.drop_near_duplicates(llm_spark.createDataFrame(rows + rows[:3], SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps, 2).values()))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_reach_every_close_pair(llm_spark, radius):
    import random
    rnd = random.Random(radius)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(200):  # chains of neighbours around them, the sign bit too
        f = rnd.choice(fps)
        for _ in range(rnd.randint(1, 3)):
            f ^= 1 << rnd.choice([0, 1, 2, 40, 62, 63])
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(llm_spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    comp = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = brute_components(dict(zip(signed, fps)), radius)
    groups = lambda label: sorted(sorted(i for i in signed if label(i) == c) for c in {label(i) for i in signed})
    assert groups(lambda i: comp.get(i, i)) == groups(want.get)


def test_components_of_chains(llm_spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(
        llm_spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_null_ids_and_empty(llm_spark):
    rows = [(None, "some words in here", "", 1), (None, "some words in here", "", 1), (3, "SOME words in here", "", 1),
            (None, "quite different one", "", 1), (None, "quite different one", "", 1)]
    d = llm_spark.createDataFrame(rows, SCHEMA)
    out = simhash.near_duplicates(d).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 0), (0, 3), (0, 3), (3, 3)]
    kept = simhash.drop_near_duplicates(d).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "quite different one"), (3, "SOME words in here")]
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.drop_near_duplicates(d.limit(0)).count() == 0


def test_one_id_with_different_texts(llm_spark):
    """Every component keeps a document, also where its smallest id has another text elsewhere."""
    a, b, x, y = ("one two three four five six", "seven eight nine ten eleven", "red green blue black white", "up down left right back")
    rows = [(1, a), (1, b), (3, x), (5, x), (5, y), (5, y), (7, a)]
    docs = llm_spark.createDataFrame([(i, t, "e", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted([(1, a), (1, b), (3, x), (5, y)])
