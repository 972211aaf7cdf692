import collections
import zlib

import numpy as np
import pytest

from loomset.llm import decontam, pii, quality
from tests.conftest import SF
from tests.llm.test_packing import slow_ids
from tests.llm.test_simhash import roots, slow_fp

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [decontam.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        if name == "quality":
            model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
            places = quality.Places()
            want = {i for i, r in before.items() if model.score(quality.pooled(places.of(r.text), model.vectors)[None])[0] >= 0.7}
            assert {r.doc_id for r in after} == want and 0.6 < len(want) / len(before) < 1
        elif name == "near_duplicates":
            fps = {i: slow_fp(r.text) for i, r in before.items()}
            group = roots(set(fps.values()))
            first = {}
            for i, f in sorted(fps.items(), reverse=True):
                first[group[f]] = i
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "decontamination":
            want = {i for i, r in before.items() if not any(x in decontam.normalised(r.text) for x in items)}
            assert {r.doc_id for r in after} <= want and len(after) >= 0.98 * len(want)
        elif name == "pii":
            assert {r.doc_id for r in after} == set(before)
            for r in after:
                assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
                if not list(pii.islands_of(before[r.doc_id].text)):
                    assert r.text == before[r.doc_id].text
        if name != "packing":
            assert docs.columns == columns and columns == ["doc_id", "text", "lang", "source", "n_chars"]
    used = collections.defaultdict(int)
    whole = collections.defaultdict(dict)
    for r in after:
        used[r.sequence_id] += r.length
        whole[r.doc_id][r.start] = r
    assert max(used.values()) <= 4096 and set(whole) == set(before)
    for i, parts in whole.items():
        ids = slow_ids(before[i].text) if len(before[i].text) < 3000 else None
        for start, r in parts.items():
            assert ids is None or r.ids_crc32 == zlib.crc32(np.array(ids[start : start + 4096], "<u4").tobytes())
    assert len(used) <= -(-sum(used.values()) // 4096) + 2


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert rows and all(0 <= r.offset < 4096 and r.length <= 4096 for r in rows)
