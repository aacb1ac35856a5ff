"""What an arriving line costs: one parse, and no copy of a new table."""

from pyspark.sql import functions as F

from transcript_jobs.sources import tables
from transcript_jobs.streaming import arrivals


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([("f", '{"video_id": "v", "segments": [{"start": 0, "end": 1, "text": "a"}]}')], "file string, line string")
    told = tables.told_apart(lines)
    assert plan(told).count("parseJson(") == 1
    good = lines.select(F.lit("v").alias("video_id"), F.lit(0).alias("part"), F.col("line").alias("raw"))
    assert plan(tables.explode_segments(good)).count("parseJson(") == 1
    assert tables.explode_segments(good).count() == 1


def test_lists_and_other_segments(spark):
    cases = {"[]": 0, "null": 0, "3": 0, '"abc"': 0, '{"a": 1}': 0, "[null]": 1, "[null, {}]": 2}
    rows = [(k, '{"video_id": "v", "segments": %s}' % k) for k in cases] + [("none", '{"video_id": "v"}')]
    found = tables.explode_segments(spark.createDataFrame(rows, "video_id string, raw string")).groupBy("video_id").count().collect()
    assert {r["video_id"]: r["count"] for r in found} == {k: n for k, n in cases.items() if n}


def test_keys_with_escapes_are_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    start = '{"video_id": "v", "segments": [{"start": 0, "end": 1, "text": "a b c"}], "p\\u0061rts": 2, "part": '
    for i in (0, 1):
        (tmp_path / "in" / f"{i}.json").write_text(f"{start}{i}}}\n")
        arrivals.stream_index(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), buckets=2).awaitTermination()
        if i == 0:
            assert not tables.exists(spark, str(tmp_path / "out"), "videos")
    assert [r["text"] for r in tables.load_table(spark, str(tmp_path / "out"), "segments").collect()] == ["a b c"] * 2


def test_a_new_table_is_not_written_aside(spark, tmp_path):
    written = []
    rows = spark.createDataFrame([("v", 0, 0.0, 1.0, "x")], arrivals.ARRIVED)

    def scratch(df):
        written.append(df)
        return df.localCheckpoint()

    for n in (0, 1):
        tables.replace_buckets(rows, str(tmp_path), "segments", rows.select("video_id"), scratch, 2)
        assert len(written) == n and tables.load_table(spark, str(tmp_path), "segments").count() == 1
