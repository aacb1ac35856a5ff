"""Outcomes of a run, and agreement of transcripts."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("url_validation", "transcript_processing", "summarization")


def pipeline_outcomes(results: DataFrame) -> DataFrame:
    """(video_id, success, failed_stage, error, chat_available) of stage rows (video_id, stage, success, error).

    The first failed stage of STAGES is the video's; a failed indexing only takes the chat away.
    """
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    failed = ~F.col("success") & (place > 0)
    first = F.min(F.when(failed, F.struct(place.alias("place"), "stage", "error")))
    g = results.groupBy("video_id").agg(first.alias("f"), F.bool_or(~F.col("success") & (F.col("stage") == "indexing")).alias("no_chat"))
    ok = F.col("f").isNull()
    return g.select("video_id", ok.alias("success"), F.col("f.stage").alias("failed_stage"), F.col("f.error").alias("error"), (ok & ~F.coalesce("no_chat", F.lit(False))).alias("chat_available"))


#: Pairs of equal words that are held in arrays at once; texts with more of them are walked through by difflib.
PAIRS = 1 << 20


def _runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of equal words begin in x and in y, and how long they are: each as long as can be."""
    order = np.argsort(y, kind="stable")
    first, last = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = last - first
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    begins = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1))) if len(i) else np.zeros(0, int)
    return i[begins], j[begins], np.diff(np.append(begins, len(i)))


def _matches(x: np.ndarray, y: np.ndarray) -> int:
    """Words in the matching blocks of SequenceMatcher: the longest run, the earliest in x and then in y, and so on to its left and right."""
    todo, total = [_runs(x, y)], 0
    while todo:
        i, j, n = todo.pop()
        if not len(n):
            continue
        best = np.flatnonzero(n == n.max())
        best = best[np.lexsort((j[best], i[best]))[0]]
        bi, bj, k = i[best], j[best], n[best]
        total += int(k)
        left = np.minimum(n, np.minimum(bi - i, bj - j))
        own = left > 0
        todo.append((i[own], j[own], left[own]))
        cut = np.maximum(0, np.maximum(bi + k - i, bj + k - j))
        own = n > cut
        todo.append((i[own] + cut[own], j[own] + cut[own], n[own] - cut[own]))
    return total


def _matching(a: str | None, b: str | None) -> tuple[int, int]:
    """How many of two texts' lower-cased words match, as difflib's SequenceMatcher finds it, and how many words they have together."""
    x, y = (a or "").lower().split(), (b or "").lower().split()
    _, ids = np.unique(np.array([*x, *y], dtype=object), return_inverse=True)
    own, other = ids[: len(x)], ids[len(x) :]
    pairs = np.bincount(own, minlength=len(ids)) @ np.bincount(other, minlength=len(ids))
    if pairs <= PAIRS:
        return _matches(own, other), len(ids)
    return sum(block.size for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()), len(ids)


def transcript_agreement(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """(video_id, run, agreement) of rows (video_id, run, text): 2M/T of matching word blocks with the baseline's text.

    Texts are compared in a task each; for long videos use sliced_agreement.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2.0 * m / n if n else 1.0 for m, n in (_matching(x, y) for x, y in zip(a, b, strict=True))], dtype="float64")

    b = baseline.select("video_id", F.col("text").alias("_b"))
    return runs.join(b, "video_id").select("video_id", "run", ratio(F.col("_b"), F.col("text")).alias("agreement"))


def sliced_agreement(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """transcript_agreement of runs (video_id, run, n, text) and a baseline (video_id, n, text) cut into slices n.

    A row compares a slice; matches and words are summed to a ratio of each video and run. A slice that one side
    lacks counts with its words.
    """

    @F.pandas_udf("matches long, words long")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_matching(x, y) for x, y in zip(a, b, strict=True)], columns=["matches", "words"], dtype="int64")

    b = baseline.select("video_id", "n", F.col("text").alias("_b"))
    every = runs.select("video_id", "run").distinct().join(b, "video_id")
    known = runs.join(b.select("video_id").distinct(), "video_id", "left_semi")
    both = every.join(known, ["video_id", "run", "n"], "full").select("video_id", "run", compare(F.col("_b"), F.col("text")).alias("c"))
    words = F.sum("c.words")
    ratio = F.when(words > 0, 2.0 * F.sum("c.matches") / words).otherwise(1.0)
    return both.groupBy("video_id", "run").agg(ratio.alias("agreement"))
