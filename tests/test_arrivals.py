"""Arrivals: two streams on one folder, retries in mid-batch, videos in several files and lines that can't be read end with the tables of one clean run."""

import datetime
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from transcript_jobs.jobs import flows
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch, publish, shared_dir
from transcript_jobs.streaming import arrivals

TEXTS = {f"v{i}": [f"what is number {n} of video {i}?" if n % 3 == 0 else f"words {n} of {i}, and more." for n in range(5 + i)] for i in range(1, 6)}


def line(v, texts=None, first=0, **more):
    texts = TEXTS[v] if texts is None else texts
    return json.dumps({"video_id": v, **more, "segments": [{"start": first + i, "end": first + i + 1, "text": t} for i, t in enumerate(texts)]})


def halves(v):
    t, n = TEXTS[v], len(TEXTS[v]) // 2
    return line(v, t[:n], part=0, parts=2, title="first"), line(v, t[n:], n, part=1, parts=2, title="second", language="en")


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def index(spark, src, out, check, buckets=3, **more):
    arrivals.stream_index(spark, str(src), str(out), str(check), buckets=buckets, **more).awaitTermination()


def contents(spark, out):
    """The rows of all tables, but for times and what only whole lines have."""
    get = lambda name, *cols: sorted(map(tuple, tables.load_table(spark, str(out), name).select(*cols).collect()))
    return {
        "videos": get("videos", "video_id", "status"),
        "segments": get("segments", "video_id", "seg_idx", "start", "end", "text"),
        "chunks": get("chunks", "video_id", "chunk_id", "start", "end", "text", "word_count"),
        "transcripts": get("transcripts", "video_id", "duration", "full_text"),
        "questions": get("questions", "video_id", "question", "start", "end", "segment_index"),
    }


def mined(spark, out, check):
    arrivals.stream_questions(spark, str(out), str(check), buckets=3).awaitTermination()
    return contents(spark, out)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    """The tables after one clean run over whole lines."""
    d = tmp_path_factory.mktemp("clean")
    put(d / "in", "all.json", *[line(v) for v in TEXTS])
    index(spark, d / "in", d / "out", d / "c")
    got = mined(spark, d / "out", d / "q")
    assert len(got["videos"]) == 5 and len({q[0] for q in got["questions"]}) == 5
    return got


def test_two_streams_on_one_folder(spark, tmp_path, clean):
    put(tmp_path / "a", "1.json", line("v1"), line("v2"))
    put(tmp_path / "b", "1.json", line("v3"), line("v4"), line("v5"))
    index(spark, tmp_path / "a", tmp_path / "out", tmp_path / "ca")
    index(spark, tmp_path / "b", tmp_path / "out", tmp_path / "cb")
    assert len(list((tmp_path / "out" / "arrived").iterdir())) == 2
    assert mined(spark, tmp_path / "out", tmp_path / "q") == clean


class Breaks:
    """An embedder that fails, as a lost worker would make the batch fail."""

    def load(self):
        raise RuntimeError("lost")


@pytest.mark.parametrize("at", ["chunks", "arrived", "videos"])
def test_a_batch_that_breaks_off(spark, tmp_path, clean, monkeypatch, at):
    """Whatever was written when it broke off, the same batch done again ends with the right tables, and questions are mined once."""
    put(tmp_path / "in", "1.json", *[line(v) for v in TEXTS])
    replace, published = tables.replace_buckets, arrivals.publish

    def breaking(df, folder, name, *more):
        if name == at:
            raise RuntimeError("lost")
        replace(df, folder, name, *more)

    def not_published(df, folder, name, key):
        if name == at:
            raise RuntimeError("lost")
        published(df, folder, name, key)

    with monkeypatch.context() as m:
        m.setattr(tables, "replace_buckets", breaking)
        m.setattr(arrivals, "publish", not_published)
        with pytest.raises(Exception, match="lost"):
            index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    if at == "videos":
        with pytest.raises(Exception, match="lost"):
            index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c", embedder=Breaks())
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert len(list((tmp_path / "out" / "arrived").iterdir())) == 1
    assert mined(spark, tmp_path / "out", tmp_path / "q") == clean


def test_videos_in_several_files(spark, tmp_path, clean):
    """Parts in one batch or in several, in any order, some delivered twice; other videos don't wait."""
    a = {v: halves(v) for v in ("v1", "v2", "v3")}
    put(tmp_path / "in", "1.json", a["v1"][1], line("v4"), a["v2"][0], a["v3"][1], a["v3"][0])
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert [r[0] for r in sorted(map(tuple, tables.load_table(spark, str(tmp_path / "out"), "videos").select("video_id").collect()))] == ["v3", "v4"]
    put(tmp_path / "in", "2.json", a["v2"][0], line("v5"))
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    put(tmp_path / "in", "3.json", a["v2"][1], a["v1"][0])
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert mined(spark, tmp_path / "out", tmp_path / "q") == clean
    v = {r["video_id"]: (r["title"], r["status"]) for r in tables.load_table(spark, str(tmp_path / "out"), "videos").collect()}
    t = {r["video_id"]: r["language"] for r in tables.load_table(spark, str(tmp_path / "out"), "transcripts").collect()}
    assert v["v1"] == ("first", "ready") and t["v1"] == "en" and t["v4"] is None


def test_parts_are_not_waited_for_for_ever(spark, tmp_path):
    """What is there of a video goes to the quarantine in time; when it comes again, whole, it is indexed."""
    index(spark, (put(tmp_path / "in", "1.json", halves("v1")[0], line("v4")), tmp_path / "in")[1], tmp_path / "out", tmp_path / "c", wait=datetime.timedelta(0))
    put(tmp_path / "in", "2.json", line("v5"))
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c", wait=datetime.timedelta(0))
    assert contents_of_quarantine(spark, tmp_path / "out") == ["parts are missing"]
    put(tmp_path / "in", "3.json", *halves("v1"))
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert sorted(contents_of(spark, tmp_path / "out", "videos", "video_id")) == ["v1", "v4", "v5"]
    assert contents_of_quarantine(spark, tmp_path / "out") == ["parts are missing"]


BAD = {
    "": "blank", "   ": "blank", "not json": "not JSON", '{"video_id": "v9", "segments": [': "not JSON", "[1, 2]": "not an object", "7": "not an object",
    '{"segments": []}': "no video_id", '{"video_id": null}': "no video_id", '{"video_id": " "}': "bad video_id", '{"video_id": {"a": 1}}': "bad video_id", '{"video_id": true}': "bad video_id",
    '{"video_id": "v9", "part": 2, "parts": 2}': "bad part", '{"video_id": "v9", "part": 0}': "bad part", '{"video_id": "v9", "part": "0", "parts": 1}': "bad part",
}


def test_lines_that_cannot_be_read(spark, tmp_path, clean):
    lines = [*BAD, *[line(v) for v in TEXTS]]
    put(tmp_path / "in", "1.json", *lines)
    put(tmp_path / "in", "2.json", "more that is no json")
    want = sorted([("1.json", k, r) for k, r in BAD.items()] + [("2.json", "more that is no json", "not JSON")])
    read = tables.read_lines(spark, str(tmp_path / "in"))
    rows = lambda df: sorted((pathlib.Path(r["file"]).name, r["line"], r["reason"]) for r in df.collect())
    assert rows(tables.quarantined(read)) == want
    assert tables.transcripts_of(read).count() + len(want) == len(lines) + 1
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert rows(spark.read.schema(arrivals.QUARANTINE).parquet(f"{tmp_path}/out/quarantine/*")) == want
    index(spark, tmp_path / "in", tmp_path / "out", tmp_path / "c")
    assert rows(spark.read.schema(arrivals.QUARANTINE).parquet(f"{tmp_path}/out/quarantine/*")) == want
    assert mined(spark, tmp_path / "out", tmp_path / "q") == clean


def test_read_transcripts_explodes_parts(spark, tmp_path):
    put(tmp_path / "in", "1.json", *halves("v1")[::-1], line("v2"), '{"video_id": 7, "segments": []}')
    rows = tables.explode_segments(tables.read_transcripts(spark, str(tmp_path / "in"))).orderBy("video_id", "pos").collect()
    assert [r["text"] for r in rows] == TEXTS["v1"] + TEXTS["v2"] and all(r["reason"] is None for r in rows)


def test_of_two_deliveries_the_latest(spark, tmp_path):
    batch = spark.createDataFrame([("v", line("v", [f"text {i}"])) for i in (3, 9, 1)] + [(None, "x")], "video_id string, raw string").coalesce(1)
    arrivals.index_batch(batch, str(tmp_path))
    assert contents_of(spark, tmp_path, "segments", "text") == ["text 1"]
    again = sorted((r["line"][-40:-4], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/quarantine/*").collect())
    assert [r for _, r in again].count("delivered again") == 2 and ("x"[-40:-4], "no video_id") in again
    arrivals.index_batch(batch.limit(1), str(tmp_path), batch_id=1)
    assert contents_of(spark, tmp_path, "segments", "text") == ["text 1"]  # it is ready
    arrivals.index_batch(batch.limit(1), str(tmp_path), batch_id=2, refresh=True)
    assert contents_of(spark, tmp_path, "segments", "text") == ["text 3"]
    assert len(contents_of(spark, tmp_path, "videos", "video_id")) == 1


def contents_of(spark, out, name, column):
    return [r[0] for r in tables.load_table(spark, str(out), name).select(column).collect()]


def test_parts_that_never_come(spark, tmp_path):
    lines = spark.createDataFrame([("f", halves("v1")[0]), ("f", line("v2"))], "file string, line string")
    lines = tables.told_apart(lines).withColumn("at", F.struct(F.timestamp_seconds(F.lit(0)).alias("modified"), "file", F.monotonically_increasing_id().alias("n")))
    arrivals.index_batch(lines, str(tmp_path))
    assert contents_of(spark, tmp_path, "videos", "video_id") == ["v2"]
    assert contents_of_quarantine(spark, tmp_path) == ["parts are missing"]


def contents_of_quarantine(spark, out):
    return [r["reason"] for r in spark.read.parquet(f"{out}/quarantine/*").collect()]


def test_failed_mining_leaves_no_older_questions(spark, tmp_path):
    batch = spark.createDataFrame([("v1", line("v1"))], "video_id string, raw string")
    arrivals.index_batch(batch, str(tmp_path))
    segments = tables.load_table(spark, str(tmp_path), "segments")
    arrivals.question_batch(segments, str(tmp_path))
    assert contents_of(spark, tmp_path, "questions", "video_id")
    arrivals.question_batch(segments, str(tmp_path), Breaks())
    assert not contents_of(spark, tmp_path, "questions", "video_id") and spark.read.parquet(f"{tmp_path}/question_failures").count() == 1


def test_nothing_is_left_on_the_way(spark, tmp_path):
    written = lambda: set(pathlib.Path(shared_dir(spark)).glob("written-*"))
    before = written()
    batch = spark.createDataFrame([("v1", line("v1"))], "video_id string, raw string")
    arrivals.index_batch(batch, str(tmp_path))
    arrivals.question_batch(tables.load_table(spark, str(tmp_path), "segments"), str(tmp_path))
    assert written() == before
    with Scratch(spark) as scratch:
        flows.mine_questions(tables.load_table(spark, str(tmp_path), "segments"), scratch=scratch).collect()
    assert written() == before


def test_published_once(spark, tmp_path):
    publish(spark.range(3), str(tmp_path), "log", "s-0")
    publish(spark.range(9), str(tmp_path), "log", "s-0")
    assert spark.read.parquet(f"{tmp_path}/log/s-0").count() == 3 and not list((tmp_path / "_publishing").iterdir())


def test_buckets_of_streams(spark, tmp_path):
    batch = spark.createDataFrame([(v, line(v)) for v in TEXTS], "video_id string, raw string")
    arrivals.index_batch(batch, str(tmp_path), buckets=3)
    assert {tables.layout(spark, str(tmp_path), t)["buckets"] for t in ("videos", "segments", "chunks", "transcripts")} == {3}


def test_a_table_without_its_layout(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, 0.0, 1.0, "x")], arrivals.ARRIVED)
    tables.save_table(rows, str(tmp_path), "segments", buckets=3)
    (tmp_path / "segments" / "_table.json").unlink()
    with pytest.raises(ValueError, match="_table.json"):
        tables.load_for_videos(spark, str(tmp_path), "segments", rows)
    with pytest.raises(ValueError, match="_table.json"):
        tables.save_table(rows, str(tmp_path), "segments")
