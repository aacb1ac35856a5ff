"""The embedder is called once for a text, whatever is asked of its vector."""

import pathlib

import pytest
from pyspark.sql import functions as F
from test_models import Counted

from transcript_jobs.jobs import flows
from transcript_jobs.operators import models, segments


def test_exploded_vectors_are_made_once(spark, tmp_path):
    raw = spark.createDataFrame([(f"v{i % 7}", i, float(i), i + 1.0, f"words of number {i}") for i in range(140)], "video_id string, pos int, start double, end double, text string")
    chunks = flows.index_videos(raw, Counted(tmp_path), 20)
    places = chunks.select("video_id", "chunk_id", F.posexplode("embedding").alias("place", "x")).filter("x <> 0")
    n = places.select("video_id", "chunk_id").distinct().count()
    assert n == 28 and len(list(pathlib.Path(tmp_path).iterdir())) == n


def test_vectors_asked_for_twice_are_made_once(spark, tmp_path):
    df = spark.createDataFrame([(f"text {i}",) for i in range(9)], "t string").repartition(3)
    v = models.embed_column(df, "t", Counted(tmp_path)).filter("size(embedding) > 0 AND embedding[0] > -2").repartition(2)
    assert v.select(F.explode("embedding"), F.size("embedding")).count() == 9 * 32
    assert len(list(tmp_path.iterdir())) == 9


class Lists:
    """Gives lists of as many numbers as a text has words, and only the first vector of a batch with the word few."""

    def load(self):
        return lambda texts: [[0.5] * len(t.split()) for t in texts][: 1 if "few" in texts else None]


def test_vectors_of_any_kind(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("c",)], "t string").coalesce(1)
    got = models.embed_column(df, "t", Lists(), batch_size=3).collect()
    assert [(r["t"], r["embedding"]) for r in got] == [("a b a", [0.5] * 3), ("", []), (None, []), ("c", [0.5])]
    assert models.embed_column(df.limit(0), "t", Lists()).collect() == []
    with pytest.raises(Exception, match="RESULT_ROWS_MISMATCH"):
        models.embed_column(spark.createDataFrame([("few",), ("x",)], "t string").coalesce(1), "t", Lists()).collect()


def test_blank_segments_are_found_without_the_pattern(spark):
    texts = ["a  b", " \t\n", "　 x y\x1f", "　\x1c ", "", None, "​", "﻿", "z"]
    raw = spark.createDataFrame([("v", i, float(i), i + 1.0, t) for i, t in enumerate(texts)], "video_id string, pos int, start double, end double, text string")
    clean, bad = segments.clean_segments(raw), segments.rejected_segments(raw)
    assert [(r["seg_idx"], r["text"]) for r in clean.orderBy("seg_idx").collect()] == [(0, "a b"), (1, "x y"), (2, "​"), (3, "﻿"), (4, "z")]
    assert sorted((r["reason"], r["dropped"]) for r in bad.collect()) == [("empty text", 3), ("no text", 1)]
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert patterns(clean.select("text")) == 1 and patterns(bad) == 0
