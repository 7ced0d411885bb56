import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, simhash
from graphloom.llm.marks import only_marked, write_marks
from graphloom.session import addressed, placed
from tests.llm.test_simhash import brute, brute_fp

CLASHING = ["_fp", "_file", "_row", "_metadata", "fp", "file", "row", "group", "component_id", "content"]


def test_marked_rows_come_back(spark, tmp_path):
    spark.range(5000).select("id", F.lit("a").alias("_file")).repartition(5).write.parquet(f"file://{tmp_path}/t")
    for df in (spark.read.parquet(f"file://{tmp_path}/t"), spark.range(300).withColumn("_file", F.lit("b"))):
        base = placed(df)
        rows = addressed(base, "file", "row")
        chosen = rows.filter("id % 7 = 3").select("file", "row")
        got = only_marked(base, write_marks(chosen.union(chosen), "test"))
        assert got.columns == df.columns
        assert sorted(r.id for r in got.collect()) == [i for i in range(df.count()) if i % 7 == 3]
        assert only_marked(base, write_marks(chosen.limit(0), "test")).count() == 0


def test_exploded_rows_are_told_apart(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    rows = addressed(placed(df), "file", "row")
    assert rows.select("file", "row").distinct().count() == 6


@pytest.mark.parametrize("stage", ["dedup", "quality"])
def test_clashing_columns_are_carried(spark, stage):
    rows = [(i, " ".join(f"w{i * 31 % 17 if i < 20 else i}x{k} and" for k in range(60)), *[f"{c}{i}" for c in CLASHING]) for i in range(30)]
    rows += [(*rows[0][:2], *["copy"] * len(CLASHING))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *CLASHING])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = simhash.one_of_each_group(docs) if stage == "dedup" else quality.keep(docs, labels)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    if stage == "dedup":
        assert len(got) == len({g[3] for g in brute([(r[0], brute_fp(r[1])) for r in rows])})
    else:
        assert sorted(got) == sorted(rows)
