"""What arrivals write and shuffle: texts no more often than needed, and nothing is kept for longer than the job that needs it."""

import json
import pathlib
import random
import time

import pytest
from conftest import SF
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from transcript_jobs.jobs import flows
from transcript_jobs.operators import chunking, long_videos, questions, segments
from transcript_jobs.sources import tables
from transcript_jobs.sources import testdata as D
from transcript_jobs.sources.written import Scratch, shared_dir
from transcript_jobs.streaming import arrivals


def line(v, texts, **more):
    return json.dumps({"video_id": v, **more, "segments": [{"start": i, "end": i + 1, "text": t} for i, t in enumerate(texts)]})


def lines_of(spark, *lines):
    told = tables.told_apart(spark.createDataFrame([("f", x) for x in lines], "file string, line string"))
    return told.withColumn("at", F.struct(F.timestamp_seconds(F.lit(0)).alias("modified"), "file", F.monotonically_increasing_id().alias("n")))


def column(spark, folder, name, of):
    return sorted(r[0] for r in tables.load_table(spark, str(folder), name).select(of).collect())


@pytest.fixture
def writes(monkeypatch):
    """The columns of every table that is written."""
    seen, write = [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        seen.append(self._df.columns)
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    return seen


def test_texts_are_written_once_for_a_batch_and_once_for_a_table(spark, tmp_path, writes):
    arrivals.index_batch(lines_of(spark, *[line(f"v{i}", ["a b", "", "c?"]) for i in range(5)]), str(tmp_path), buckets=2)
    texts = [c for c in writes if {"line", "raw", "text", "full_text"} & {*c}]
    assert len(texts) == 5, texts  # the lines, what is logged, and three tables
    assert column(spark, tmp_path, "segments", "text") == ["a b"] * 5 + ["c?"] * 5
    assert column(spark, tmp_path, "transcripts", "full_text") == ["a b c?"] * 5
    assert [r["n"] for r in spark.read.parquet(f"{tmp_path}/arrived/*").groupBy("video_id").agg(F.count("*").alias("n")).collect()] == [2] * 5
    assert not list((tmp_path / "_publishing").iterdir())


def test_parts_are_numbered_where_they_stand(spark, tmp_path, writes):
    """Videos of many parts, which come in any order, and whole ones: nothing more is written than for whole lines."""
    rng, lines, want = random.Random(4), [line("whole", ["a", "b"])], [("whole", 0, "a"), ("whole", 1, "b")]
    for v in ("x", "y", "z"):
        own = [[rng.choice(["", f"{v} {i} {k}", " what? "]) for k in range(rng.randrange(6))] for i in range(12)]
        lines += [line(v, t, part=i, parts=12) for i, t in enumerate(own)]
        want += [(v, i, t) for i, t in enumerate(t.strip() for part in own for t in part if t)]
    rng.shuffle(lines)
    arrivals.index_batch(lines_of(spark, *lines).repartition(5), str(tmp_path), buckets=2)
    assert sorted(map(tuple, tables.load_table(spark, str(tmp_path), "segments").select("video_id", "seg_idx", "text").collect())) == sorted(want)
    texts = [c for c in writes if {"line", "raw", "text", "full_text"} & {*c}]
    assert len(texts) == 5, texts


def test_arriving_lines_are_made_without_a_shuffle(spark):
    rows = D.whole_videos(spark, SF)
    parts = F.array_sort(F.collect_list(F.struct("pos", F.struct("start", "end", "text").alias("s"))))
    collected = D.segments(spark, SF).groupBy("video_id").agg(F.transform(parts, lambda x: x["s"]).alias("segments"))
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("video_id", "segments"))).collect())
    assert text(rows) == text(collected)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_lines_that_count_are_not_ordered(spark, tmp_path, monkeypatch):
    """Only keys tell that every line counts; where one doesn't, they are put in order as before."""
    order, called = arrivals._latest, []
    monkeypatch.setattr(arrivals, "_latest", lambda lines: (called.append(1), order(lines))[1])
    whole = [line("a", ["x"]), line("b", ["y"], part=1, parts=2), line("b", ["z"], part=0, parts=2)]
    arrivals.index_batch(lines_of(spark, *whole), str(tmp_path))
    assert not called and column(spark, tmp_path, "segments", "text") == ["x", "y", "z"]
    arrivals.index_batch(lines_of(spark, line("c", ["u"])), str(tmp_path), batch_id=1)
    assert not called and column(spark, tmp_path, "segments", "text") == ["u", "x", "y", "z"]
    uneven = [[line("d", ["1"]), line("d", ["2"])], [line("d", ["3"], part=0, parts=2), line("d", ["3"], part=0, parts=2)], [line("d", ["4"]), line("d", ["5"], part=1, parts=2)], [line("a", ["6"])]]
    for n, some in enumerate(uneven, 2):
        arrivals.index_batch(lines_of(spark, *some), str(tmp_path / str(n)) if n < 5 else str(tmp_path), batch_id=n)
        assert len(called) == n - 1
    assert column(spark, tmp_path / "2", "segments", "text") == ["2"]
    assert not any(tables.exists(spark, str(tmp_path / str(n)), "segments") for n in (3, 4))
    assert column(spark, tmp_path, "segments", "text") == ["u", "x", "y", "z"]


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_whole_lines_are_numbered_where_they_stand(spark, batch):
    rng = random.Random(batch)
    texts = lambda: [rng.choice(["a", " b  c ", "", " ", None, "what?"]) for _ in range(rng.choice([0, 1, 2, 7, 40]))]
    raw = spark.createDataFrame([(f"v{i}", line(f"v{i}", texts())) for i in range(30)], "video_id string, raw string").repartition(3)
    rows = tables.explode_segments(raw)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        numbered = long_videos.clean_lines(rows)
        assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, segments.clean_segments(rows).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = tables.explode_segments(spark.createDataFrame([("v", "{}")], "video_id string, raw string"))
    assert "Exchange" not in long_videos.clean_lines(rows)._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_shuffled_once(spark):
    clean = spark.createDataFrame([("v", i, float(i), i + 1.0, "a b c" + " d" * (i % 9)) for i in range(200)], "video_id string, seg_idx int, start double, end double, text string")
    for block, most in ((1, 5), (4, 7), (16, 200), (64, 12)):
        got = long_videos.chunk_segments(clean, most, block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.chunk_segments(clean, most).collect()))
    plan = long_videos.chunk_segments(clean)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in "".join(x for x in plan.split("\n") if "Exchange" in x), plan


def test_prompts_are_not_written(spark, tmp_path, writes):
    clean = spark.createDataFrame([("v", i, float(i), i + 1.0, f"what is number {i} of the video?") for i in range(0, 30, 3)], "video_id string, seg_idx int, start double, end double, text string")
    with Scratch(spark) as scratch:
        assert flows.mine_questions(clean, scratch=scratch).count() > 0
    assert writes and not any("messages" in c for c in writes)


def test_segments_that_are_there_twice(spark, tmp_path, writes):
    rows = [("v", i, float(i), i + 1.0, f"what is number {i} of the video?") for i in range(3)]
    asked = []
    for n, own in enumerate((rows, rows + rows[1:])):
        arrivals.question_batch(spark.createDataFrame(own, arrivals.ARRIVED), str(tmp_path / str(n)), buckets=2)
        asked.append(sorted(map(tuple, tables.load_table(spark, str(tmp_path / str(n)), "questions").collect())))
        assert sum({"seg_idx", "text"} <= {*c} for c in writes) == n  # written only to count them once
    assert asked[0] == asked[1] and asked[0]


def shuffles(spark):
    return {p.name for p in pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}


def test_shuffles_go_with_their_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(line(f"v{i}", ["a b", f"what is number {i} of the video?"]) for i in range(20)) + "\n")
    before = shuffles(spark)
    arrivals.stream_index(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), buckets=2).awaitTermination()
    arrivals.stream_questions(spark, str(tmp_path / "out"), str(tmp_path / "q"), buckets=2).awaitTermination()
    until = time.time() + 20
    while (left := {x.split("_")[1] for x in shuffles(spark) - before}) and time.time() < until:
        time.sleep(0.5)
    assert len(left) <= 3, left
    assert column(spark, tmp_path / "out", "questions", "question")


class Breaks:
    def load(self):
        raise RuntimeError("lost")


def test_a_model_that_fails_for_the_first_table(spark, tmp_path):
    """The table of chunks has its layout and no rows then; the batch done again fills it."""
    batch = lines_of(spark, line("a", ["x"]), line("b", ["y"]))
    with pytest.raises(Exception, match="lost"):
        arrivals.index_batch(batch, str(tmp_path), Breaks(), buckets=2)
    assert not tables.exists(spark, str(tmp_path), "segments")
    arrivals.index_batch(batch, str(tmp_path), buckets=2)
    assert column(spark, tmp_path, "chunks", "text") == ["x", "y"] and column(spark, tmp_path, "videos", "status") == ["ready"] * 2


@pytest.mark.parametrize("batch", [2, 5, 10_000])
def test_segments_far_from_questions_are_not_shuffled(spark, batch):
    rng = random.Random(batch)
    rows = [(v, i, float(3 * i), 3 * i + rng.choice([1.0, 3.0]), "what is it?" if rng.random() < 0.2 else f"words {i}.") for v in ("a", "b", None, "c") for i in range(rng.randrange(40))]
    clean = spark.createDataFrame(rows, "video_id string, seg_idx int, start double, end double, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for block in (1, 4, 4096):
            got = long_videos.question_windows(clean, block=block)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, questions.question_windows(clean).collect()), key=str)
        left = long_videos._near_flagged(clean.withColumn("flag", F.col("text").contains("?"))).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    near = sum(any(w[0] == v and abs(w[1] - i) <= 1 and "?" in w[4] for w in rows) for v, i, *_ in rows)
    assert near <= left < len(rows) if batch > 2 else near <= left


def test_lines_are_deleted_before_the_tables(spark, tmp_path, monkeypatch):
    """What a batch read stands on disk until its segments do."""
    folder, put, seen = pathlib.Path(shared_dir(spark).removeprefix("file:")), tables.replace_buckets, []

    def noted(df, where, name, *more):
        seen.append((name, sum("line" in spark.read.parquet(str(p)).columns for p in folder.glob("written-*/*"))))
        put(df, where, name, *more)

    monkeypatch.setattr(tables, "replace_buckets", noted)
    arrivals.index_batch(lines_of(spark, line("a", ["x"])), str(tmp_path), buckets=2)
    assert seen == [(t, 0) for t in ("chunks", "segments", "transcripts", "videos")]
