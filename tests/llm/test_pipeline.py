import re
import zlib

import numpy as np

import corpus_pipeline
from graphloom.llm import pii, quality
from graphloom.llm.tokens import encoder
from tests.llm.test_decontam_pii import brute_windows
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        if name != "pack":
            assert docs.columns == columns and len(after) == len(rows) and set(after) <= set(before)
        if name not in ("surrogates", "pack"):
            assert all(after[i] == before[i] for i in after)
        if name == "quality_rules":
            failed = {i for i, r in before.items() if (c := brute_counts(r.text))[0] < quality.MIN_WORDS or 2 * c[4] > c[0]}
            assert not failed & set(after)
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1} - failed
            assert len(good & set(after)) >= 0.97 * len(good)
        elif name == "near_dedup":
            groups = brute_groups([(i, brute_fp(r.text)) for i, r in before.items()])
            assert set(after) == {g[3] for g in groups}
        elif name == "decontaminate":
            items = set().union(*(brute_windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
            found = {i for i, r in before.items() if brute_windows(r.text) & items}
            assert not found & set(after) and len(before) - len(after) <= len(found) + 1
        elif name == "surrogates":
            assert set(after) == set(before)
            for i, r in before.items():
                spans = pii.find(r.text)
                assert (after[i].text == r.text) == (not spans)
                assert all(r.text[a:b] not in after[i].text for a, b, _ in spans)
                assert after[i].n_chars == len(after[i].text) and re.sub(r"\w", "", r.text) == re.sub(r"\w", "", after[i].text)
        else:
            by: dict = {}
            for r in rows:
                by.setdefault(r.doc_id, []).append(r)
            assert set(by) == set(before)
            for i, pieces in by.items():
                ids = np.array(encoder().tokenizer.encode(before[i].text, add_special_tokens=False).ids + [2], "<u4")
                pieces.sort(key=lambda r: r.piece)
                assert sum(r.length for r in pieces) == len(ids)
                assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "no id " * 80, "en", "s", 1), (-3, "long word " * 40_000, "en", "s", 1)], docs.schema)
    for table in (docs.unionByName(odd).unionByName(docs.limit(20)), docs.limit(0)):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"file://{tmp_path}/{table.count()}-{k}"
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.count() <= 3 * table.count() and ("sequence_id" in now.columns)
