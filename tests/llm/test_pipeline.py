"""The pipeline against its operators applied one by one, and its decisions."""
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from courtside.llm import quality, secrets, simhash, toxicity
from courtside.llm.common import table, written
from courtside.llm.queries import quality_train, toxic_train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(llm_spark):
    docs, out = table(llm_spark, SF, "documents"), []
    for name, f in pipeline.STAGES:
        docs = written(f(llm_spark, docs, SF), "test-stage")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(llm_spark, stages):
    want = table(llm_spark, SF, "documents").schema
    for name in list(stages)[:-1]:
        assert [(f.name, f.dataType) for f in stages[name].schema] == [(f.name, f.dataType) for f in want]


def test_filters_follow_the_classifiers(llm_spark, stages):
    docs, labels = table(llm_spark, SF, "documents"), table(llm_spark, SF, "labels")
    good = quality.classify(docs, labels, quality_train()).where("predicted = 1")
    assert ids(stages["quality"]) == ids(good)
    kept = stages["quality"]
    calm = toxicity.scored(kept, toxicity.learn(kept, labels, toxic_train())).where("predicted = 0")
    assert ids(stages["toxicity"]) == ids(calm)
    lab = labels.join(docs, "doc_id").select("doc_id", "quality", "toxic")
    clean = lab.where("quality = 1 AND toxic = 0").count()
    stay = stages["toxicity"].join(lab, "doc_id").groupBy("quality", "toxic").count().collect()
    by = {(r.quality, r.toxic): r["count"] for r in stay}
    assert by[1, 0] >= 0.97 * clean and sum(v for k, v in by.items() if k != (1, 0)) <= 3


def test_one_of_each_group(stages):
    rows = stages["toxicity"].select("doc_id", "text").collect()
    fps = {r.doc_id: simhash.fingerprint_bytes(r.text.encode()) for r in rows}
    up = {}
    a = np.array([fps[i] for i in sorted(fps)], dtype=np.uint64)
    order = sorted(fps)

    def top(i):
        while up.get(i, i) != i:
            i = up[i]
        return i
    for i, f in zip(order, a):
        for j in np.nonzero(np.bitwise_count(a ^ f) <= 2)[0]:
            x, y = sorted((top(i), top(order[j])))
            up[y] = x
    assert ids(stages["near_duplicates"]) == sorted({top(i) for i in order})


def test_secrets_are_gone_and_all_documents_stay(stages):
    assert ids(stages["secrets"]) == ids(stages["near_duplicates"])
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    for r in stages["secrets"].collect():
        assert secrets.base_spans(r.text.replace("[SECRET]", "")) == [] and r.n_chars == len(r.text)
        if not secrets.base_spans(before[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id]


def test_packed_ids_are_the_documents(stages):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [1] for r in stages["secrets"].collect()}
    got = {}
    for r in stages["packing"].orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == want


def test_run_is_the_stages(llm_spark, stages):
    cols = ["doc_id", "start", "length", "ids_crc32"]
    whole = pipeline.run(llm_spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    parts = stages["packing"].select(*cols).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
