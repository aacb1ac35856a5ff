"""What summaries cost: chunks are read once, prompts are kept for second attempts alone, and nothing is stored but what can be."""

import json
import os

from pyspark.sql import functions as F
from test_stored_summaries import RESULT, VIDEO, result, stored, video

from transcript_jobs import params as P
from transcript_jobs.jobs import flows
from transcript_jobs.operators import models
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch


def reply(n):
    return json.dumps({"summary_lines": [f"line {i}" for i in range(n)], "main_topics": [], "key_points": [], "conclusions": []})


def files(folder):
    return {f"{d}/{n}" for d, _, names in os.walk(f"{folder}/videos") for n in names if n.endswith(".parquet")}


def test_chunks_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [("v1", 1, "a b"), ("v1", 2, " "), ("v2", 1, " \n"), ("v3", 1, "word " * 800), ("v4", 1, None)]
    chunks = spark.createDataFrame(rows, "video_id string, chunk_id int, text string").withColumn("video_id", told("video_id"))
    got = {r["video_id"]: (r["summary"] and len(r["summary"]["summary"].splitlines()), r["error"]) for r in flows.summarize_videos(chunks, models.FixedGenerator(reply(16))).collect()}
    assert got == {"v1": (16, None), "v2": (None, P.NOTHING_TO_SUMMARIZE), "v3": (16, None), "v4": (None, P.NOTHING_TO_SUMMARIZE)}
    assert seen.value == len(rows)


def test_prompts_of_second_attempts_alone(spark):
    kept = []

    class Watched(Scratch):
        def __call__(self, df):
            out = super().__call__(df)
            if df.columns == ["video_id", "messages", "summary"]:
                kept.append(out.filter("messages IS NOT NULL").count())
            return out

    chunks = spark.createDataFrame([("v1", 1, "a b"), ("v2", 1, "c d")], "video_id string, chunk_id int, text string")
    for n in (16, 3):
        with Watched(spark) as scratch:
            assert {len(r["summary"]["summary"].splitlines()) for r in flows.summarize_videos(chunks, models.FixedGenerator(reply(n)), scratch).collect()} == {n}
    assert kept[0] == 0 and kept[2] == 2


def test_results_that_cannot_be_stored_write_nothing(spark, tmp_path):
    folder = str(tmp_path)
    tables.save_table(spark.createDataFrame([video(f"v{i}", 2, 1) for i in range(20)], VIDEO), folder, "videos", buckets=4)
    before = files(folder)
    flows.save_summaries(spark.createDataFrame([result(f"v{i}", 2, raw="x") for i in range(20)] + [result("v1", None), result("v2", 2, None)], RESULT), folder)
    assert files(folder) == before
    flows.save_summaries(spark.createDataFrame([result("v1", 2), result("v2", 2, raw="x")], RESULT), folder)
    assert len(files(folder) & before) == 3  # the bucket of v1 alone is written anew
    got = stored(tables.load_table(spark, folder, "videos"))
    assert len(got) == 20 and got.pop("v1") == (("new", 3), 2) and set(got.values()) == {(("old", 2), 1)}


def test_a_bucket_is_written_without_a_copy_aside(spark, tmp_path, monkeypatch):
    folder, aside = str(tmp_path), []
    tables.save_table(spark.createDataFrame([video(f"v{i}", 2, 1) for i in range(20)], VIDEO), folder, "videos", buckets=4)
    write = Scratch.__call__
    monkeypatch.setattr(Scratch, "__call__", lambda self, df: aside.append(df.columns) or write(self, df))
    flows.save_summaries(spark.createDataFrame([result(f"v{i}", 2) for i in range(0, 20, 2)], RESULT), folder)
    assert aside == [["video_id", "summary", "made_at"]]
    assert sorted(x[0][1] for x in stored(tables.load_table(spark, folder, "videos")).values()) == [2] * 10 + [3] * 10
