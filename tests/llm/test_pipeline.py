import os
import random

import pytest

import corpus_pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_stages_keep_columns_and_drop_copies(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    docs = docs.union(spark.createDataFrame([(90001, first.text, "en", "s", 1), (90002, first.text + " more", "en", "s", 1), (None, None, None, None, None)], docs.schema))
    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 90001 in ids and first.doc_id not in ids and None in ids
    near = corpus_pipeline.drop_near_copies(spark, kept, sf)
    assert near.columns == docs.columns and len({90001, 90002} & {r.doc_id for r in near.select("doc_id").collect()}) <= 1
    calm = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert calm.columns == docs.columns and 0 < calm.count() <= docs.count()


def test_each_group_keeps_one_row(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(4))
    rows = [(7, a)] * 30 + [(3, a)] + [(None, b)] * 5 + [(1, c), (9, c + " end"), (9, d), (None, c + " tail"), (None, "")] + [(2, None)] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    told = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)
    exact = corpus_pipeline.drop_copies(spark, docs, "")
    assert exact.columns == docs.columns
    assert told(exact) == sorted([(7, a), (None, b), (1, c), (9, c + " end"), (9, d), (None, c + " tail"), (2, None)], key=repr)
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert near.columns == docs.columns
    assert told(near) == sorted([(7, a), (None, b), (1, c), (9, d), (2, None)], key=repr)
    # without exact dedup before it, near dedup still keeps one row of each group; rows without words all stay
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert told(near) == sorted([(3, a), (None, b), (1, c), (9, d), (None, ""), (2, None), (2, None)], key=repr)
