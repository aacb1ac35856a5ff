"""Summaries are read a hundred outputs at a time: no Arrow batch of ten thousand whole outputs stands in a worker."""

import pytest
from pyspark.sql import functions as F

from transcript_jobs.functions import summary_json as J

ODD = '{"summary_lines": ["the "odd" one",\n"two"], "main_topics": ["a"]}'


@pytest.mark.parametrize("read", [J.parse_summary, J.salvage_lines, J.final_summary])
def test_no_arrow_batches(spark, read):
    df = spark.createDataFrame([(ODD,)], "raw string").select(read(F.col("raw")).alias("got"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_rows_beyond_a_batch(spark):
    rows = [(i, (ODD, None, "", "prose")[i % 4]) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, raw string").coalesce(1)
    got = {r["i"]: r for r in df.select("i", J.parse_summary(F.col("raw")).alias("p"), J.final_summary(F.col("raw")).alias("f"), J.salvage_lines(F.col("raw")).alias("s")).collect()}
    assert len(got) == 1000
    for i, r in got.items():
        f = r["f"].asDict()
        if i % 4 == 0:
            assert r["p"]["summary"] == 'the "odd" one\ntwo' and r["p"]["key_points"] == [] and f["main_topics"] == ["a"] and f["raw_output"] is None and r["s"] is None
        else:
            assert r["p"] is None and r["s"] is None and f["main_topics"] == f["key_points"] == f["conclusions"] == []
            assert f["summary"] == f["raw_output"] == rows[i][1]
