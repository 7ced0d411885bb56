from graphloom.llm import decontam

ITEMS = ["Compute 12 + 30 - 5", "What is photosynthesis?", "What is 12 plus 30?", "12 km plus 30 km minus 5 km equals what", "1 2 3 4 5 6 7 8 9 10", None, ""]


def test_items_without_plain_windows_are_found_verbatim(spark):
    texts = [f"before {t} after" for t in ITEMS[:5]] + ["Compute 12 + 30", "somewhat is photosynthesis", "What is 12 plus 31?", ITEMS[1], "what", "is photosynthesis", None]
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (decontam.INDEX_ROWS, 2):
        got = sorted((r.doc_id, r.item_id, r.n_windows, r.verbatim) for r in decontam.contaminated(docs, bench, index_rows=rows).collect())
        assert got == [*((i, i, 1, True) for i in range(5)), (8, 1, 1, True)]
        kept = sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench, index_rows=rows).collect())
        assert kept == [5, 6, 7, 9, 10, 11]
