"""Which videos are indexed, cached or still to do. Joins on the video id; only keys are on the right-hand side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs import params as P


def indexed_videos(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Videos that are ready and have a chunk."""
    return videos.filter(F.col("status") == P.READY).join(chunks.select("video_id"), "video_id", "left_semi")


def cached_summaries(videos: DataFrame, chunks: DataFrame, version: int = P.SUMMARY_VERSION) -> DataFrame:
    """Indexed videos whose summary is of this version; no summary, or an older one, is a miss."""
    return indexed_videos(videos.filter(F.col("summary.version") == version), chunks)


def storable(results: DataFrame) -> DataFrame:
    """Results (video_id, summary, made_at) that were read: with a summary that is no raw output, and a time."""
    s = F.col("summary")
    return results.filter(s["summary"].isNotNull() & s["raw_output"].isNull() & F.col("made_at").isNotNull())


def merge_summaries(videos: DataFrame, results: DataFrame, version: int = P.SUMMARY_VERSION) -> DataFrame:
    """``videos``, those with a newer summary among ``results`` (video_id, summary, made_at) with it, its version and its time.

    A result is stored if it was read (it has no raw_output), its version isn't below the stored one's, and it wasn't made
    before the video was last changed. Of several for one video the last made counts. Results of other videos are
    left aside, videos without a result stay as they are; the join is by video, and results are reduced first.
    """
    s = F.col("summary")
    own = F.struct(*[s[c].alias(c) for c in ("summary", "main_topics", "key_points", "conclusions", "raw_output")], F.lit(version).alias("version"))
    last = storable(results).groupBy("video_id").agg(F.max(F.struct("made_at", own.alias("summary"))).alias("_new"))
    newer = (F.coalesce(s["version"], F.lit(-1)) <= version) & (F.coalesce(F.col("updated_at") <= F.col("_new.made_at"), F.lit(True)))
    take = F.col("_new").isNotNull() & newer
    pick = {"summary": F.when(take, F.col("_new.summary")).otherwise(s), "updated_at": F.when(take, F.col("_new.made_at")).otherwise(F.col("updated_at"))}
    return videos.join(last, "video_id", "left").select(*[pick.get(c, F.col(c)).alias(c) for c in videos.columns])


def videos_to_process(incoming: DataFrame, indexed: DataFrame, refresh: bool = False) -> DataFrame:
    """Incoming videos that aren't indexed; all of them with ``refresh``."""
    return incoming if refresh else incoming.join(indexed.select("video_id"), "video_id", "left_anti")


def cached_questions(videos: DataFrame, questions: DataFrame) -> DataFrame:
    """(video_id, questions): a video's stored questions by start, or NULL if none was ever stored."""
    q = F.array_sort(F.collect_list(F.struct("start", "segment_index", "question", "end")))
    return videos.select("video_id").join(questions.groupBy("video_id").agg(q.alias("questions")), "video_id", "left")
