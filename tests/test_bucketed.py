"""Bucketed tables: no exchange for windows, chunks and joins by video; replacing touches the groups of a batch alone."""

import pathlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from transcript_jobs.operators import chunking, questions, segments
from transcript_jobs.sources import bucketed
from transcript_jobs.sources import testdata as D


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bucketed"))
    raw = D.segments(spark, SF)
    bucketed.save(raw, folder, "raw_segments", buckets=6, groups=3)
    bucketed.save(segments.clean_segments(raw), folder, "segments", buckets=6, groups=3)
    return folder


def rows(df):
    return sorted(map(str, df.collect()))


def test_no_exchange(spark, stored):
    """Clean, window and chunk over stored segments, one after the other and each alone, and a join of two tables."""
    raw, clean = (bucketed.load(spark, stored, n) for n in ("raw_segments", "segments"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            segments.clean_segments(raw),
            questions.question_windows(segments.clean_segments(raw)),
            chunking.chunk_segments(segments.clean_segments(raw)),
            questions.question_windows(clean),
            questions.cap_candidates(questions.question_windows(clean)),
            chunking.chunk_segments(clean),
            clean.join(raw.select("video_id").distinct(), "video_id", "left_semi"),
            segments.full_text(clean),
        ):
            assert "Exchange" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_rows(spark, stored):
    clean = segments.clean_segments(D.segments(spark, SF))
    assert rows(bucketed.load(spark, stored, "segments")) == rows(clean)
    assert rows(chunking.chunk_segments(bucketed.load(spark, stored, "segments"))) == rows(chunking.chunk_segments(clean))


def test_replace(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(400).selectExpr("concat('v', id % 40) AS video_id", "CAST(id AS INT) AS seg_idx", "0D AS start", "1D AS end", "'old' AS text")
    bucketed.replace(df, folder, "segments", df, buckets=4, groups=8)
    files = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(folder).rglob("*.parquet")}
    before = files()
    some = df.filter("video_id IN ('v1', 'v2')")
    bucketed.replace(some.filter("seg_idx < 100").withColumn("text", F.lit("new")), folder, "segments", some)
    got = {(r["video_id"], r["text"]): r["count"] for r in bucketed.load(spark, folder, "segments").groupBy("video_id", "text").count().collect()}
    assert got == {(f"v{i}", "old"): 10 for i in range(40) if i not in (1, 2)} | {("v1", "new"): 3, ("v2", "new"): 3}
    kept = {p for p in files() if before.get(p) == files()[p]}
    assert len({p.parent for p in kept}) >= 6  # two groups at most were written
    bucketed.replace(df.limit(0), folder, "segments", df.filter("video_id <> 'v7'"))
    assert {r["video_id"] for r in bucketed.load(spark, folder, "segments").collect()} == {"v7"}
    one = bucketed.load(spark, folder, "segments", spark.createDataFrame([("v7",)], "video_id string"))
    assert one.count() == 10


def test_another_session(spark, stored):
    """The layout is with the files: a session that has not written them reads them by buckets too."""
    other = spark.newSession()
    called = bucketed._registered(spark, stored, "segments")
    spark.sql(f"DROP TABLE {called}")  # the catalog of this test's sessions is one; the files stay
    clean = bucketed.load(other, stored, "segments")
    assert clean.count() == segments.clean_segments(D.segments(spark, SF)).count() and "Exchange" not in plan_of(chunking.chunk_segments(clean))
    with pytest.raises(ValueError, match="no bucketed table"):
        bucketed.load(spark, stored, "chunks")
