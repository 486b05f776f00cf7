"""The pipeline against its stages done plainly, with planted cases."""

import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from test_op7_simhash import brute_components, brute_print

from tickerlake.llm import op6_pii, wordtokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    first = given.orderBy("doc_id").first()
    planted = [
        (100_000, first.text, first.lang, "src1", len(first.text)), (100_001, "12 34 -- 56", "en", "src1", 11), (100_002, None, "en", "src1", 0), (100_003, "", None, None, None),
        (100_004, "the offer that he made is to be sent to jo.doe@mail.example.com or +1 (202) 555-0143 by all of them", None, None, 5),
        (100_005, first.text, first.lang, "src1", len(first.text)), (100_005, first.text, first.lang, "src1", len(first.text)),
    ]
    return given.unionByName(spark.createDataFrame(planted, given.schema)).repartition(3).cache()


def test_stages(spark, docs):
    told = cp.language(spark, docs, SF).cache()
    assert told.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in told.select("doc_id").collect()}
    assert gone == {100_001, 100_002, 100_003}
    single = cp.near_duplicates(spark, told, SF).cache()
    assert single.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in told.collect()]
    prints = {t: brute_print(t) for _, t in rows}
    label = brute_components(set(prints.values()))
    least = {}
    for i, t in rows:
        least[label[prints[t]]] = min(i, least.get(label[prints[t]], i))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    clean = cp.personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, clean))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not op6_pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not op6_pii.TRIGGER.search(before[i].text):
            assert r.text == before[i].text
    assert after[100_004].text == "the offer that he made is to be sent to [EMAIL] or [PHONE] by all of them"
    chunks = wordtokens.Chunks(wordtokens.vocabulary_path())
    want = []
    for i, r in after.items():
        ids = np.append(chunks.ids([r.text])[0], 1).astype("<u4")
        want += [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    packed = cp.packing(spark, clean, SF).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_run(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 150
