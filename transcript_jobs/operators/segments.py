"""Raw segments to cleaned, numbered segments; what was dropped; full texts. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.text import clean_text, filled, strip


def reject_reason() -> Column:
    """Why a raw segment can't be used; NULL for a good one. NaN is the largest double to Spark, so it is named."""
    number = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return (
        F.when(~(number(F.col("start")) & number(F.col("end"))), "no finite times")
        .when((F.col("start") < 0) | (F.col("end") < 0), "negative time")
        .when(F.col("end") < F.col("start"), "ends before it starts")
        .when(F.col("text").isNull(), "no text")
    )


def valid_segment() -> Column:
    return reject_reason().isNull()


def clean_segments(raw: DataFrame) -> DataFrame:
    """(video_id, seg_idx, start, end, text): valid segments with cleaned texts, empty ones dropped, numbered from 0 by pos.

    One shuffle, by video; the operators on segments that follow reuse it.
    """
    good = raw.filter(valid_segment() & (strip(F.col("text")) != "")).withColumn("text", clean_text(F.col("text")))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1
    return good.select("video_id", n.alias("seg_idx"), "start", "end", "text")


def rejected_segments(raw: DataFrame) -> DataFrame:
    """(video_id, reason, dropped): counts of what clean_segments leaves out."""
    reason = F.coalesce(reject_reason(), F.when(strip(F.col("text")) == "", "empty text"))
    return raw.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("video_id", "reason").agg(F.count("*").alias("dropped"))


def transcript_status(transcripts: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(video_id, success, error) per transcript (video_id, has_segments): no list fails, no usable segment fails."""
    n = cleaned.groupBy("video_id").agg(F.count("*").alias("n"))
    error = F.when(~F.col("has_segments"), P.BAD_TRANSCRIPT).when(F.col("n").isNull(), P.NO_SEGMENTS)
    return transcripts.join(n, "video_id", "left").select("video_id", error.isNull().alias("success"), error.alias("error"))


def full_text(segments: DataFrame) -> DataFrame:
    """(video_id, full_text): the texts in order, by single spaces. A video's text is one string, so it must fit in a task."""
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return segments.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("full_text"))


def fixed_windows(videos: DataFrame, window: float = 30.0) -> DataFrame:
    """(video_id, n, start, end): consecutive windows over [0, duration); the last may be shorter."""
    last = F.ceil(F.col("duration") / window).cast("int") - 1
    every = F.when(F.col("duration") > 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    at = videos.select("video_id", "duration", F.explode(every).alias("n"))
    return at.select("video_id", "n", (F.col("n") * window).alias("start"), F.least(F.col("duration"), (F.col("n") + 1) * window).alias("end"))


def normalize_metadata(df: DataFrame) -> DataFrame:
    """title and channel (else uploader) with their defaults; NULL becomes '' elsewhere."""
    return df.select(
        "video_id",
        filled(F.col("title"), F.lit("Unknown title")).alias("title"),
        filled(F.col("channel"), filled(F.col("uploader"), F.lit("Unknown channel"))).alias("channel"),
        F.coalesce("thumbnail", F.lit("")).alias("thumbnail"),
    )
