"""Questions asked in a video: flagged segments, windows, validated answers, duplicates, ranks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.text import (
    HEDGE,
    LABEL,
    format_timestamp,
    grounding_overlap,
    is_pure_filler,
    normalize_question,
    relevance_score,
    segment_has_candidate,
    strip,
    timestamp_url,
    word_count,
)
from transcript_jobs.operators.chunking import by_video
from transcript_jobs.operators.models import embed_column

SYSTEM = (
    "Find the question that is asked, word for word, in a piece of a video transcript. Tidy grammar only; add nothing. "
    "Reply with the question alone, ending in a question mark, or with NONE if no real question is asked or you are unsure. "
    "Small talk such as 'okay?' is no question. Never explain your reply."
)


def question_windows(segments: DataFrame, max_gap: float = P.MERGE_GAP) -> DataFrame:
    """(video_id, segment_index, start, end, text): runs of flagged segments, with a segment of context on each side.

    A run goes on while the next segment is flagged too and begins at most ``max_gap`` seconds after the last
    one's end. All windows and the grouping are by video: one shuffle.
    """
    order = Window.partitionBy("video_id").orderBy("seg_idx")
    flagged = segments.withColumn("flag", segment_has_candidate(F.col("text"))).select(
        "*",
        F.lag("flag").over(order).alias("flag_before"),
        F.lag("end").over(order).alias("end_before"),
        F.lag("text").over(order).alias("text_before"),
        F.lead("text").over(order).alias("text_after"),
    )
    opens = ~F.coalesce("flag_before", F.lit(False)) | (F.col("start") - F.col("end_before") > max_gap)
    runs = flagged.withColumn("run", F.sum(F.when(F.col("flag") & opens, 1).otherwise(0)).over(order)).filter("flag")
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    at = lambda f, c: f(c, "seg_idx")
    return runs.groupBy("video_id", "run").agg(
        F.min("seg_idx").alias("segment_index"),
        at(F.min_by, "start").alias("start"),
        at(F.max_by, "end").alias("end"),
        F.array_join(
            F.array_compact(
                F.concat(F.array(at(F.min_by, "text_before")), F.transform(ordered, lambda x: x["text"]), F.array(at(F.max_by, "text_after")))
            ),
            " ",
        ).alias("text"),
    ).drop("run")


def cap_candidates(windows: DataFrame, limit: int = P.CANDIDATES) -> DataFrame:
    """At most ``limit`` windows of a video: those with a question mark first, then by place."""
    order = Window.partitionBy("video_id").orderBy(F.desc(F.col("text").contains("?")), "segment_index")
    return windows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def question_prompts(windows: DataFrame) -> DataFrame:
    """Adds ``messages``: what a model is asked about each window."""
    return windows.withColumn("messages", messages(F.lit(SYSTEM), F.concat(F.lit("Transcript excerpt:\n\n"), "text")))


def messages(system: Column, user: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def accept_questions(answered: DataFrame) -> DataFrame:
    """Adds ``question`` to the rows (…, text, output) whose output is a real question of the window; drops the others."""
    a = strip(F.regexp_replace(strip(F.coalesce(F.col("output"), F.lit(""))), LABEL, ""))
    sure = lambda a: (a != "") & ~F.upper(a).startswith("NONE") & ~a.rlike(HEDGE)
    asked = lambda a: normalize_question(F.get(F.split(a, r"\R"), F.lit(0)))
    grounded = lambda q: grounding_overlap(q, F.col("text")) >= P.GROUNDING
    fits = lambda q: q.endswith("?") & word_count(q).between(3, 40) & ~is_pure_filler(q) & grounded(q)
    # lists of one output, so that each step is done once, and only for what the step before leaves
    found = F.filter(F.transform(F.filter(F.array(a), sure), asked), fits)
    return answered.withColumn("question", F.explode(found)).drop("output")


#: Questions that are compared at once.
DEDUPE_BLOCK = 1024


def _distinct(v: np.ndarray, threshold: float) -> list[int]:
    """Rows of v, in order, whose product with every kept row before is below the threshold."""
    kept = np.array([], int)
    for x in range(0, len(v), DEDUPE_BLOCK):
        block = v[x : x + DEDUPE_BLOCK]
        fresh = np.ones(len(block), bool)
        for y in range(0, len(kept), DEDUPE_BLOCK):
            fresh[fresh] = ~(block[fresh] @ v[kept[y : y + DEDUPE_BLOCK]].T >= threshold).any(axis=1)
        near, own = block[fresh] @ block[fresh].T >= threshold, []
        for i in range(len(near)):
            if not near[i, own].any():
                own.append(i)
        kept = np.append(kept, x + np.flatnonzero(fresh)[own])
    return kept.tolist()


def dedupe_questions(questions: DataFrame, threshold: float = P.DEDUPE, embedder=None) -> DataFrame:
    """Questions without those whose cosine to an earlier kept one of the video reaches ``threshold`` (but for rounding).

    A video's questions are gone through in blocks of DEDUPE_BLOCK: a block is compared with the kept ones in matrix parts, then
    within itself; so memory grows with the questions, not with their pairs.
    """
    fields = [f for f in questions.schema.fields if f.name != "_v"]

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        ids, v = rows["video_id"].to_numpy(), np.stack(rows["_v"]).astype(float)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        kept: list[int] = []
        for a, b in itertools.pairwise(edges):
            kept += [a + i for i in _distinct(v[a:b], threshold - 1e-6)]
        return rows.loc[kept, [f.name for f in fields]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return by_video(embed_column(questions.filter("video_id IS NOT NULL"), "question", embedder, "_v"), ["start", "segment_index"], keep, schema)


def rank_questions(questions: DataFrame, limit: int = P.QUESTIONS) -> DataFrame:
    """At most ``limit`` questions of a video, the most relevant, then the earliest."""
    order = Window.partitionBy("video_id").orderBy(F.desc(relevance_score(F.col("question"))), "start", "segment_index")
    return questions.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def serialize_questions(questions: DataFrame) -> DataFrame:
    """(video_id, id from 1 by start, question, start, end, timestamp, youtube_url)."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "segment_index"))
    return questions.select(
        "video_id", n.alias("id"), "question", "start", "end", format_timestamp(F.col("start")).alias("timestamp"),
        timestamp_url(F.col("video_id"), F.col("start")).alias("youtube_url"),
    )
