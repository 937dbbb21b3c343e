import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from courtside.llm import bpe, packing

SCHEMA = "doc_id long, text string, ids string, n long"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "  two  spaces\n\n next", "It's they'll we've I'm he'd", "naïve Ünïcode 漢字 \U0001f600", "1234 5678",
         "tabs\tand\x0bmore\x1c\x85 ", "a" * 50_000, "word " * 3000, "\n", "x\n y", "<|endoftext|> inside", "\x00\x01",
         "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def test_perfect_hash_is_minimal_and_total():
    keys = [str(i).encode() for i in range(1000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(1000)) and all(h.find(k) == i for i, k in enumerate(keys))
    assert bpe.PerfectHash([b"only"]).find(b"only") == 0


def test_same_ids_as_the_library(reference):
    _, encoder = bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(1)
    signs = " \t\n\r\x0b\x1c\x85 　abcé'stlvem漢字1२½ⅷ_!$́\U0001f600"
    texts = [t for t in TEXTS if t is not None] + [
        "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)


def test_small_memory_changes_nothing(reference):
    from courtside.llm.pretokens import TextEncoder
    v, _ = bpe.codec(RANKS, P.PATTERN)
    encoder = TextEncoder(lambda ts: [v.encode_pretoken(t) for t in ts], P.PATTERN, limit=3)
    for text in ["one two three, four five six seven", "two eight, one. one one nine", "six  six two"] * 3:
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_encode_decode_job(llm_spark, reference):
    d = docs(llm_spark, TEXTS)
    enc = bpe.encode(d, RANKS, P.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode(enc, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in bpe.encode(d, RANKS, P.PATTERN, digests=True).collect():
        t = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(d.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("partitions,merge,open_windows", [(1, 64, 32), (7, 3, 2), (20, 4, 1)])
def test_packing_loses_no_id(llm_spark, partitions, merge, open_windows):
    tok = Tokenizer.from_file(JSON)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    assert added
    texts = TEXTS + [f"x {a} y{a}" for a in added] + [f"{added[0]}", f" {added[0][:-1]} {added[0]}\n"] + ["thing and more " * (i % 60) for i in range(150)]
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    d = docs(llm_spark, texts).repartition(partitions, "doc_id")
    rows = packing.pack(d, JSON, P.PATTERN, window=256, open_windows=open_windows, merge_partitions=merge).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, rs in by_doc.items():
        rs.sort(key=lambda r: r.start)
        assert [r.start for r in rs] == np.cumsum([0] + [r.length for r in rs])[:-1].tolist()
        assert np.frombuffer(b"".join(bytes(r.ids) for r in rs), "<u4").tolist() == want[i]
        assert {r.doc_tokens for r in rs} == {len(want[i])}
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0] + [r.length for r in rs])[:-1].tolist()
        n = sum(r.length for r in rs)
        assert n == 256 or n < 256 and n & (n - 1) == 0  # full, or a power of two: no padding


def test_best_fit_and_fullest():
    p = packing.Packer(10, 2)
    put = lambda n: [w.used for w in p.put(packing.Piece(0, 0, b"\0" * 4 * n, n))]
    assert put(6) == [] and put(7) == [] and put(3) == [10]  # 3 fits best beside 7
    assert [w.used for w in p.open] == [6]
    assert put(9) == [] and sorted(w.used for w in p.open) == [6, 9]
    # 5 fits nowhere: it fills the fullest (9), its other 4 ids just fit beside 6
    assert put(5) == [10, 10] and p.open == []


def test_packing_null_ids_repeats_and_empty(llm_spark):
    d = llm_spark.createDataFrame([(None, "a b c", "", 1), (None, None, "", 1), (5, "x", "", 1), (5, "x", "", 1)], SCHEMA)
    rows = packing.pack(d, JSON, P.PATTERN, keep_ids=False).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows if r.length == r.doc_tokens)
    assert sum(r.length for r in rows) == 4 + 1 + 2 + 2
    assert packing.pack(d.limit(0), JSON, P.PATTERN).count() == 0
