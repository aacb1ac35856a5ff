"""Stored summaries: never a raw output, never over a newer version or a later change; a stored one is a cache hit."""

import datetime
import json

from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.jobs import flows
from transcript_jobs.operators import index, models
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch

TEXT = "struct<summary: string, main_topics: array<string>, key_points: array<string>, conclusions: array<string>, raw_output: string>"
VIDEO = tables.SCHEMAS["videos"]
RESULT = f"video_id string, summary {TEXT}, made_at timestamp"


def at(n):
    return datetime.datetime(2024, 1, 1, n)


def video(v, version, hour, text="old", status="ready"):
    s = None if version is None else (text, [], [], [], None, version)
    return (v, "u", "t", "c", "", "", status, s, at(0), at(hour) if hour is not None else None)


def result(v, hour, text="new", raw=None):
    return (v, None if text is None else (text, ["a"], [], [], raw), at(hour) if hour is not None else None)


def stored(df):
    return {r["video_id"]: (r["summary"] and (r["summary"]["summary"], r["summary"]["version"]), r["updated_at"] and r["updated_at"].hour) for r in df.collect()}


def test_conditions(spark):
    videos = spark.createDataFrame(
        [video("none", None, 5), video("older", 2, 5), video("same", 3, 5), video("newer", 4, 5), video("changed", None, 9), video("raw", 2, 5), video("untimed", None, None),
         video("several", None, 5), video("empty", 3, 5), video("kept", 3, 5)], VIDEO,
    )
    results = spark.createDataFrame(
        [result("none", 6), result("older", 6), result("same", 6), result("newer", 6), result("changed", 6), result("raw", 6, raw="x"), result("untimed", 6), result("several", 6, "a"),
         result("several", 8, "b"), result("several", 7, "c"), result("several", 9, "d", raw="d"), result("empty", 6, None), result("unknown", 6), result(None, 6), result("kept", None)], RESULT,
    )
    out = index.merge_summaries(videos, results)
    assert out.columns == videos.columns
    assert stored(out) == {
        "none": (("new", 3), 6), "older": (("new", 3), 6), "same": (("new", 3), 6), "newer": (("old", 4), 5), "changed": (None, 9), "raw": (("old", 2), 5), "untimed": (("new", 3), 6),
        "several": (("b", 3), 8), "empty": (("old", 3), 5), "kept": (("old", 3), 5),
    }
    assert stored(index.merge_summaries(out, results)) == stored(out)  # again, nothing changes
    assert stored(index.merge_summaries(videos.limit(0), results)) == {} and stored(index.merge_summaries(videos, results.limit(0))) == stored(videos)


def test_later_run_is_a_cache_hit(spark, tmp_path):
    folder = str(tmp_path)
    tables.save_table(spark.createDataFrame([video("v1", None, 1), video("v2", 3, 1), video("v3", 2, 1), video("v4", None, 1, status="failed"), video("v5", 4, 1)], VIDEO), folder, "videos", buckets=3)
    chunks = [(f"v{i}", 1, 0.0, 1.0, f"text of {i}", 3, None) for i in range(1, 6)]
    tables.save_table(spark.createDataFrame(chunks, tables.SCHEMAS["chunks"]), folder, "chunks", buckets=3)
    lines = [f"line {i}" for i in range(16)]
    good = models.FixedGenerator(json.dumps({"summary_lines": lines, "main_topics": [], "key_points": [], "conclusions": []}))
    run = lambda g, **more: {r["video_id"]: (r["cached"], r["summary"]["summary"] if r["summary"] else None, r["error"]) for r in flows.summarize_stored(spark, folder, g, **more).collect()}
    with Scratch(spark) as scratch:
        first = run(models.FixedGenerator("prose"), scratch=scratch)
    assert first == {"v1": (False, "prose", None), "v2": (True, "old", None), "v3": (False, "prose", None), "v5": (False, "prose", None)}
    done = "\n".join(lines)
    assert run(good) == {"v1": (False, done, None), "v2": (True, "old", None), "v3": (False, done, None), "v5": (False, done, None)}
    # v5 has a newer version, which stays: for this version it is a miss each time
    assert run(good) == {"v1": (True, done, None), "v2": (True, "old", None), "v3": (True, done, None), "v5": (False, done, None)}
    v = {r["video_id"]: r["summary"]["version"] if r["summary"] else None for r in tables.load_table(spark, folder, "videos").collect()}
    assert v == {"v1": P.SUMMARY_VERSION, "v2": 3, "v3": 3, "v4": None, "v5": 4}
    assert all(not cached for cached, _, _ in run(good, refresh=True).values())
    assert tables.load_table(spark, folder, "videos").filter(F.col("summary.summary") == done).count() == 3


def test_failing_model_stores_nothing(spark, tmp_path):
    folder = str(tmp_path)
    tables.save_table(spark.createDataFrame([video("v1", None, 1)], VIDEO), folder, "videos", buckets=2)
    tables.save_table(spark.createDataFrame([("v1", 1, 0.0, 1.0, "text", 1, None)], tables.SCHEMAS["chunks"]), folder, "chunks", buckets=2)

    class Fails:
        def load(self):
            def run(batch):
                raise ValueError("no")

            return run

    got = flows.summarize_stored(spark, folder, Fails()).collect()
    assert [(r["summary"], r["cached"], r["error"]) for r in got] == [(None, False, P.NO_SUMMARY)]
    assert tables.load_table(spark, folder, "videos").filter("summary IS NULL").count() == 1
