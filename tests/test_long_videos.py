"""Videos of any length: ranges with carried borders give the rows of whole videos, on random splits."""

import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from transcript_jobs.operators import chunking, long_videos, models, questions, segments
from transcript_jobs.sources import testdata as D

RAW = "video_id string, pos long, start double, end double, text string"


def raw_rows(seed, n=250):
    """Raw segments of some videos, dirty ones among them; runs of questions that are long, some with gaps in time."""
    rng, out = random.Random(seed), []
    for v in ("a", "b", None, "c" * 20, "one"):
        at, asking = 0.0, False
        for pos in range(1 if v == "one" else rng.randrange(n)):
            asking ^= rng.random() < 0.15
            at += rng.choice([0.0, 1.0, 1.0, 2.5])
            words = rng.choice([0, 1, 1, 2, 3, 5, 9, 40]) * ["w%d" % pos]
            text = " ".join(words) + (" what is it?" if asking and words else "")
            end = at + rng.choice([1.0, 2.0, -1.0]) if rng.random() < 0.9 else float("nan")
            out.append((v, pos + (1 << 33) * (pos // 150), at, end, rng.choice([text, text, text, f"  {text} ", None])))
            at += 1.0
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("block", "seed"), [(1, 1), (7, 2), (64, 1), (4096, 2)])
def test_same_rows(spark, block, seed):
    raw = spark.createDataFrame(raw_rows(seed), RAW)
    clean = segments.clean_segments(raw)
    assert rows(long_videos.clean_segments(raw, block)) == rows(clean)
    clean = spark.createDataFrame(clean.collect(), clean.schema)
    for gap in (0.5, 2.0):
        assert rows(long_videos.question_windows(clean, gap, block)) == rows(questions.question_windows(clean, gap))
    for most in (1, 4, 30):
        assert rows(long_videos.chunk_segments(clean, most, block)) == rows(chunking.chunk_segments(clean, most))
    for f in (long_videos.clean_segments, long_videos.question_windows, long_videos.chunk_segments):
        assert f((raw if f is long_videos.clean_segments else clean).limit(0)).count() == 0


def test_one_run_over_many_blocks(spark):
    """Every segment asks: one window of the whole video."""
    clean = spark.createDataFrame([("v", i, float(i), i + 1.0, f"why is it {i}?") for i in range(50)], "video_id string, seg_idx int, start double, end double, text string")
    assert rows(long_videos.question_windows(clean, block=4)) == rows(questions.question_windows(clean))


@pytest.mark.parametrize("most", [1, 3, 10, 50])
def test_tables_of_blocks(most):
    """A block's table against one segment after the other; tables put together are the table of the whole."""
    rng = random.Random(most)
    for _ in range(200):
        counts = np.array([rng.choice([0, 1, 2, 3, 7, most, most + 1, 2 * most + 1]) for _ in range(rng.randint(0, 12))], np.int64)
        left, opened = long_videos.exits(counts, most)
        for entry in range(most + 1):
            w, c = entry, 0
            for n in counts.tolist():
                if n > most:
                    w, c = 0, c + -(-n // most)
                elif n and w and w + n <= most:
                    w += n
                elif n:
                    w, c = n, c + 1
            assert (left[entry], opened[entry]) == (w, c)
        cut = rng.randint(0, len(counts))
        (la, oa), (lb, ob) = long_videos.exits(counts[:cut], most), long_videos.exits(counts[cut:], most)
        assert (lb[la] == left).all() and (oa + ob[la] == opened).all()


def test_whole_tables(spark):
    raw = D.segments(spark, SF)
    assert rows(long_videos.clean_segments(raw, 16)) == rows(segments.clean_segments(raw))
    clean = segments.clean_segments(raw)
    assert rows(long_videos.question_windows(clean, block=16)) == rows(questions.question_windows(clean))
    assert rows(long_videos.chunk_segments(clean, block=16)) == rows(chunking.chunk_segments(clean))


def test_no_task_has_a_whole_video(spark):
    """Segments are brought together by video and block alone; what is ordered by video is a row per block."""
    clean = spark.createDataFrame([("v", i, float(i), i + 1.0, "why is it so?") for i in range(3)], "video_id string, seg_idx int, start double, end double, text string")
    raw = clean.withColumnRenamed("seg_idx", "pos")
    for df in (long_videos.clean_segments(raw), long_videos.question_windows(clean), long_videos.chunk_segments(clean)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        by_video = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(video_id#\d+, \d+\)", line)]
        assert len(by_video) == 1, plan
        assert re.search("HashAggregate.*b#|FlatMapGroupsInPandas", lines[by_video[0] + 1])  # a row per block


def test_distinct_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want: list[int] = []
    for i in range(len(v)):
        if not (v[i] @ v[want].T >= 0.8).any():
            want.append(i)
    for block in (1, 3, 64, 1000):
        monkeypatch.setattr(questions, "DEDUPE_BLOCK", block)
        assert questions._distinct(v, 0.8) == want


def test_many_questions_of_one_video(spark):
    """50,000 questions, half of them asked twice, within a task's memory: all pairs would take 20 GB."""
    q = spark.range(50_000).selectExpr("'v' AS video_id", "concat('q', id % 25000) AS question", "CAST(id AS DOUBLE) AS start", "CAST(id AS INT) AS segment_index")
    got = questions.dedupe_questions(q, embedder=models.HashEmbedder(64)).select("segment_index").toPandas()["segment_index"]
    v = models.HashEmbedder(64).load()([f"q{i}" for i in range(25_000)])
    places = {tuple(np.flatnonzero(x)) + (float(x.sum()),) for x in v}  # one word: one place and sign
    assert len(got) == len(places) and got.max() < 25_000


def test_no_call_for_each_block(spark):
    """Many short videos: a split's blocks are gone through in one call, and what is open is followed by a search per chunk."""
    clean = spark.createDataFrame([("v", i, float(i), i + 1.0, "why is it so?") for i in range(3)], "video_id string, seg_idx int, start double, end double, text string")
    plan = long_videos.chunk_segments(clean)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMap" not in plan, plan
    rng = random.Random(5)
    for most in (1, 3, 10):
        for _ in range(100):
            counts = np.array([rng.choice([0, 1, 2, 7, most, most + 1, 3 * most]) for _ in range(rng.randint(0, 12))], np.int64)
            left, opened = long_videos.exits(counts, most)
            assert all(long_videos.passed(counts, most, e) == (left[e], opened[e]) for e in range(most + 1))
