import pytest

from graphloom.llm import decontam

ITEM = "What is the sum of 12 and 30 if we add them by hand?"
COPY = "What is the sum of {} and {} if we add them by hand? "


@pytest.mark.parametrize("text, found", [(COPY.format(3, 4) + COPY.format(5, 9), True), (COPY.format(7, 7), True), (COPY.format(3, 4) * 2, True), ("What is the sum of nothing", False)])
def test_each_occurrence_counts_by_itself(spark, text, found):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.verbatim) for r in decontam.contaminated(docs, bench).collect()] == [(5, 1, False)] * found
