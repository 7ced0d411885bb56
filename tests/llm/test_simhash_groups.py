import numpy as np

import corpus_pipeline


def test_groups_that_share_their_least_id_are_all_kept(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(12)]
    rows = [(7, t) for t in texts[:6]] + [(None, t) for t in texts[6:]]
    rows += [(7, texts[0]), (9, texts[1]), (3, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    want = [("7", texts[0]), ("7", texts[1]), ("3", texts[2]), *(("7", t) for t in texts[3:6]), *(("None", t) for t in texts[6:])]
    assert got == sorted(want)
