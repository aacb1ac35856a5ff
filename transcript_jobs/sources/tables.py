"""Tables with fixed schemas: reading raw transcripts, loading, saving, upserts and replacement."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from transcript_jobs import params as P
from transcript_jobs.sources.written import CODEC, Scratch, file_system, settings

SCHEMAS = {
    "videos": "video_id string, url string, title string, channel string, duration string, thumbnail string, status string, "
    "summary struct<summary: string, main_topics: array<string>, key_points: array<string>, conclusions: array<string>, "
    "raw_output: string, version: int>, created_at timestamp, updated_at timestamp",
    "transcripts": "video_id string, language string, duration double, full_text string",
    "raw_segments": "video_id string, pos long, start double, end double, text string",
    "segments": "video_id string, seg_idx int, start double, end double, text string",
    "chunks": "video_id string, chunk_id int, start double, end double, text string, word_count int, embedding array<float>",
    "vectors": "video_id string, chunk_id int, cell int, distance double, embedding array<float>",
    "cells": "video_id string, cell int, n long, nearest double, farthest double, pivot array<double>",
    "questions": "video_id string, question string, start double, end double, segment_index int",
    "sessions": "session_id string, video_id string, created_at timestamp",
    "messages": "session_id string, msg_id long, role string, message string, sources array<struct<chunk_id: int, start: double, "
    "end: double, similarity: double, label: string, youtube_url: string>>, created_at timestamp",
}
#: Tables are laid out by buckets of the video id (a partition per video would be a file per video), each in so many files.
BUCKETS, FILES = 64, 1
_PROPERTIES = "_table.json"
#: A task that writes so many buckets at most keeps their files open, and its rows are not sorted by bucket before, which would spill them.
_OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "4"}


def video_bucket(n: int = BUCKETS):
    return F.pmod(F.xxhash64("video_id"), F.lit(n)).cast("int")


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether anything was ever written to the table."""
    files, path = file_system(spark, f"{folder}/{name}")
    return files.exists(path)


def layout(spark: SparkSession, folder: str, name: str) -> dict[str, int]:
    """The stored layout of a table: buckets, and files of each; the defaults for one that was never written.

    A table without its layout can't be used: reading it by other buckets than it was written by would miss rows.
    """
    files, path = file_system(spark, f"{folder}/{name}/{_PROPERTIES}")
    if not files.exists(path):
        if exists(spark, folder, name):
            raise ValueError(f"{folder}/{name} has no {_PROPERTIES}: write one with its number of buckets and files")
        return {"buckets": BUCKETS, "files": FILES}
    stream = files.open(path)
    stored = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(stored)


def load_table(spark: SparkSession, folder: str, name: str, bucket: bool = False) -> DataFrame:
    """A table with its fixed schema; no inference. ``bucket``: with video_bucket too, by which files are skipped."""
    if "video_id" not in SCHEMAS[name]:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    df = spark.read.schema(SCHEMAS[name] + ", video_bucket int").parquet(f"{folder}/{name}")
    return df if bucket else df.drop("video_bucket")


def load_for_videos(spark: SparkSession, folder: str, name: str, ids: DataFrame) -> DataFrame:
    """All rows of the buckets that the videos ``ids`` lie in; other buckets' files aren't opened."""
    touched = ids.select(video_bucket(layout(spark, folder, name)["buckets"]).alias("video_bucket")).distinct()  # a row per bucket at most
    return load_table(spark, folder, name, bucket=True).join(F.broadcast(touched), "video_bucket", "left_semi").drop("video_bucket")


def save_table(df: DataFrame, folder: str, name: str, mode: str = "append", buckets: int | None = None, files: int | None = None, whole: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> None:
    """Writes a table with its fixed schema; those with a video id by bucket, and ``overwrite`` replaces the buckets in df only.

    The layout is set by the first write and kept with the table: take about a bucket per GB that it will grow to,
    and more files where a bucket is too much for one task. ``whole`` makes the table's rows of those of ``df`` after these are dealt out, a video's to
    one task: it groups by the columns that it is given, which needs no other shuffle.
    """
    spark = df.sparkSession
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    df = df if whole else df.to(schema)
    if "video_id" not in df.columns:
        df.write.mode(mode).parquet(f"{folder}/{name}", compression=CODEC)
        return
    own = layout(spark, folder, name)
    if not exists(spark, folder, name):  # first of all, so that a write that breaks off leaves no table of unknown layout
        own = {"buckets": buckets or own["buckets"], "files": files or own["files"]}
        out_files, path = file_system(spark, f"{folder}/{name}/{_PROPERTIES}")
        stream = out_files.create(path, True)
        stream.write(bytearray(json.dumps(own).encode()))
        stream.close()
    part = F.pmod(F.xxhash64("video_id", F.lit(1)), F.lit(own["files"]))
    out = df.withColumn("video_bucket", video_bucket(own["buckets"])).withColumn("_file", part).repartition("video_bucket", "_file")
    if whole:
        out = whole(out, ["video_bucket", "_file", "video_id"])
    with settings(spark, _OPEN_FILES):
        out.to(StructType([*schema, StructField("video_bucket", IntegerType())])).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("video_bucket").parquet(f"{folder}/{name}", compression=CODEC)


def replace_buckets(
    rows: DataFrame, folder: str, name: str, ids: DataFrame, scratch: Scratch, buckets: int | None = None, files: int | None = None, whole: Callable[[DataFrame, list[str]], DataFrame] | None = None
) -> None:
    """Puts ``rows`` in place of all rows of the videos ``ids``; the buckets of these videos are read, written aside and then overwritten; a new table is written at once.

    ``whole``: see save_table.
    """
    spark = rows.sparkSession
    if not exists(spark, folder, name):  # nothing is read that is overwritten, and no bucket can be left over
        save_table(rows, folder, name, "overwrite", buckets, files, whole)
        return
    rows = (whole(rows, ["video_id"]) if whole else rows).to(spark.createDataFrame([], SCHEMAS[name]).schema)
    rows = scratch(replace_for_videos(load_for_videos(spark, folder, name, ids), rows, ids))
    save_table(rows, folder, name, "overwrite", buckets, files)
    # an overwrite leaves buckets alone that have no row any more
    bucket = video_bucket(layout(spark, folder, name)["buckets"]).alias("b")
    for r in ids.select(bucket).distinct().join(rows.select(bucket).distinct(), "b", "left_anti").collect():  # a row per bucket at most
        out_files, path = file_system(spark, f"{folder}/{name}/video_bucket={r['b']}")
        out_files.delete(path, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, video_id, part, parts, reason) of every line of the files; see told_apart."""
    text = spark.read.text(path)
    return told_apart(text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))


def told_apart(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with video_id, part, parts and ``reason``: why a line can't be read, NULL for a good one.

    A line is a JSON object with a video_id, a text that isn't blank or a whole number. A video whose segments come in
    several lines has in each of them their number, ``parts``, and its own, ``part``, from 0; other lines are whole.
    """
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))

    def told(v: Column) -> Column:
        field = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
        number = lambda k: F.when(kind(field(k)) == "BIGINT", F.try_variant_get(v, f"$.{k}", "int"))
        video = F.when(kind(field("video_id")).isin("STRING", "BIGINT"), F.try_variant_get(v, "$.video_id", "string"))
        is_part = (kind(field("part")) != "VOID") | (kind(field("parts")) != "VOID")
        part, parts = F.when(is_part, number("part")).otherwise(0), F.when(is_part, number("parts")).otherwise(1)
        good_part = F.coalesce((part >= 0) & (part < parts), F.lit(False))
        reason = (
            F.when(F.trim(F.coalesce("line", F.lit(""))) == "", "blank")
            .when(v.isNull(), "not JSON")
            .when(~F.col("line").rlike(r"^[ \t\r\n]*\{"), "not an object")  # the kind of the whole would walk through all of it
            .when(kind(field("video_id")) == "VOID", "no video_id")
            .when(video.isNull() | (F.trim(video) == ""), "bad video_id")
            .when(~good_part, "bad part")
        )
        return F.struct(video.alias("video_id"), part.alias("part"), parts.alias("parts"), reason.alias("reason"))

    rows = lines.withColumn("_t", F.get(F.transform(F.array(F.try_parse_json("line")), told), F.lit(0)))  # a line is parsed once, for all that is told of it
    return rows.select("*", "_t.video_id", "_t.part", "_t.parts", "_t.reason").drop("_t")


def quarantined(lines: DataFrame) -> DataFrame:
    """(file, line, reason) of the lines that can't be read."""
    return lines.filter("reason IS NOT NULL").select("file", "line", "reason")


def transcripts_of(lines: DataFrame) -> DataFrame:
    """(video_id, part, raw) of the lines that can be read; raw is left as it is, since its parts may have any type."""
    return lines.filter("reason IS NULL").select("video_id", "part", F.col("line").alias("raw"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, part, raw) of the good lines of the files, one JSON object a line; ``quarantined(read_lines(...))`` has the others."""
    return transcripts_of(read_lines(spark, path))


def explode_segments(raw: DataFrame) -> DataFrame:
    """(video_id, pos, start, end, text, reason) per element of ``segments``: typed where the JSON type is right.

    ``reason`` is set for what isn't an object, for times that are no numbers (true and "1" are none) and for
    texts that are no strings. An input without a list of segments gives no rows. Where ``raw`` has a column part too, ``pos``
    goes on from part to part (with gaps).
    """
    own = ["video_id", "part"] if "part" in raw.columns else ["video_id"]
    place = F.col("pos").cast("int") if len(own) == 1 else F.shiftleft(F.col("part").cast("long"), 32) + F.col("pos")
    kind = lambda c: F.schema_of_variant(c)
    # a list has a first element or no rows; the kind of the whole list would walk through all of it
    listed = lambda v: F.when(F.try_variant_get(v, "$.segments[0]", "variant").isNotNull(), F.try_variant_get(v, "$.segments", "variant"))
    e = raw.select(*own, F.get(F.transform(F.array(F.try_parse_json("raw")), listed), F.lit(0)).alias("s"))
    e = e.lateralJoin(e.sparkSession.tvf.variant_explode(F.col("s").outer())).select(*own, "pos", F.col("value").alias("x"))
    part = lambda k: F.try_variant_get("x", f"$.{k}", "variant")
    number = lambda k: F.coalesce(kind(part(k)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    text = F.coalesce(kind(part("text")) == "STRING", F.lit(False))
    is_object = F.coalesce(kind("x").startswith("OBJECT"), F.lit(False))
    return e.select(
        "video_id",
        place.alias("pos"),
        *[F.when(is_object & number(k), F.try_variant_get("x", f"$.{k}", "double")).alias(k) for k in ("start", "end")],
        F.when(is_object & text, F.try_variant_get("x", "$.text", "string")).alias("text"),
        F.when(~is_object, "not an object").when(~(number("start") & number("end")), "bad times").when(~text, "bad text").alias("reason"),
    )


def upsert_videos(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All videos: those incoming get the new metadata and status processing, and keep a stored summary and creation time.

    Both sides are shuffled by the video once; ``incoming`` has one row per video.
    """
    old = existing.select("video_id", F.col("summary").alias("_summary"), F.col("created_at").alias("_created"))
    fresh = incoming.join(old, "video_id", "left").select(
        "video_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("url", "title", "channel", "duration", "thumbnail")],
        F.lit(P.PROCESSING).alias("status"),
        F.col("_summary").alias("summary"),
        F.coalesce("_created", "updated_at").alias("created_at"),
        "updated_at",
    )
    return existing.join(incoming, "video_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def replace_for_videos(existing: DataFrame, incoming: DataFrame, video_ids: DataFrame) -> DataFrame:
    """``existing`` without any row of the given videos, and ``incoming`` in their place."""
    return existing.join(video_ids.select("video_id").distinct(), "video_id", "left_anti").unionByName(incoming.select(*existing.columns))
