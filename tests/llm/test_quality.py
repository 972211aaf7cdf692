import zlib

import numpy as np
from pyspark.sql import functions as F

from loomset.llm import quality
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classified(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_scores_come_from_texts_alone(spark, docs_of):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = docs_of([*ODD, *[(100 + i, ("good words here " if i % 2 else "BAD!! BAD!! ") * (i % 7 + 1)) for i in range(200)]])
    model = quality.fit(docs, labels)
    a = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    changed = docs.withColumn("source", F.lit("other")).withColumn("quality_score", F.lit("clash"))
    assert a == {r.doc_id: r.quality_score for r in quality.score(changed, model).collect()}
    assert a[1] == a[2] == a[3] and quality.score(docs, model).count() == docs.count()
    assert min(a[101], a[103]) > 0.7 > max(a[100], a[102])


def test_nothing_to_learn_from(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = quality.classified(docs_of(ODD), labels).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    assert quality.classified(docs_of([]), none).count() == 0


def test_pooled_is_the_mean_over_words():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    places = quality.Places().of("One two two THREE!! three 44 É")
    got = quality.pooled(places, vectors)
    want = np.mean([vectors[p // quality.SHAPES] for p in places], 0)
    assert np.allclose(got[: quality.WIDTH], want, atol=1e-5)
    total = np.zeros_like(vectors)
    quality.contexts(places, total)
    assert np.isclose(np.abs(total).sum() > 0, True)
