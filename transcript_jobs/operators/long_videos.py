"""The operators on segments for videos of any length: ranges of a video's segments are worked on apart, and what crosses a border is carried.

They give the rows of segments.clean_segments, questions.question_windows and chunking.chunk_segments, which see a video in
one task. Here a task sees BLOCK segments of a video at a time; only summaries, a row per block, are put in order by video, and those of
blocks after a video's first are broadcast. They read their input more than once, so give them a stored table.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.text import clean_text, segment_has_candidate
from transcript_jobs.operators.chunking import CHUNK, group_edges, pack, whole_groups
from transcript_jobs.operators.segments import valid_segment

#: Segments of a video that one task sees together: half a day of speech.
BLOCK = 4096


def _before(summaries: DataFrame, of: Column) -> DataFrame:
    """(video_id, b, carry): ``of`` over all earlier blocks of the video, for the blocks that there are; a row per block."""
    earlier = Window.partitionBy("video_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.select("video_id", "b", of.over(earlier).alias("carry"))


def _with_carry(rows: DataFrame, carry: DataFrame, order: str) -> DataFrame:
    """``rows`` (video_id, b, ...) with the ``carry`` of their block, by a guest row in each block; so a null video is one like others, and nothing is joined."""
    kind = carry.schema["carry"].dataType
    both = rows.withColumn("carry", F.lit(None).cast(kind)).withColumn("_guest", F.lit(False))
    both = both.unionByName(carry.withColumn("_guest", F.lit(True)), allowMissingColumns=True)
    by = Window.partitionBy("video_id", "b")
    placed = both.withColumn("carry", F.max("carry").over(by)).withColumn("_n", F.row_number().over(by.orderBy("_guest", order)))
    return placed.filter("NOT _guest").drop("_guest")


def _good(raw: DataFrame) -> DataFrame:
    return raw.filter(valid_segment()).filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))


def clean_segments(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """(video_id, seg_idx, start, end, text): valid segments with cleaned texts, numbered from 0 by pos: within their block, from the sum of the blocks before."""
    b = F.floor(F.col("pos") / block).cast("long").alias("b")
    good = _good(raw)
    counts = good.groupBy("video_id", b).agg(F.count("*").alias("n"))
    rows = good.select("video_id", b, "pos", "start", "end", clean_text(F.col("text")).alias("text"))
    out = _with_carry(rows, _before(counts, F.sum("n")), "pos")
    return out.select("video_id", (F.coalesce("carry", F.lit(0)) + F.col("_n") - 1).cast("int").alias("seg_idx"), "start", "end", "text")


def clean_lines(raw: DataFrame) -> DataFrame:
    """clean_segments of rows that tables.explode_segments just made of lines: the lines of a video follow each other in a split, in order, and so
    do its segments, which are numbered where they stand, without a shuffle.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("video_id")
            edges = np.flatnonzero(ids.slice(1).to_numpy(zero_copy_only=False) != ids.slice(0, len(ids) - 1).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], edges])
            out = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0].as_py() == video:
                out[: starts[1] if len(starts) > 1 else len(ids)] += n
            video, n = ids[-1].as_py(), int(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.int32()), *map(b.column, ("start", "end", "text"))], names=["video_id", "seg_idx", "start", "end", "text"])

    rows = _good(raw).select("video_id", "start", "end", clean_text(F.col("text")).alias("text"))
    return rows.mapInArrow(numbered, "video_id string, seg_idx int, start double, end double, text string")


def _of_long(rows: DataFrame, block: int) -> DataFrame:
    """The rows (video_id, seg_idx, ...) of the videos that go beyond their first block: fewer than the rows' ``block``-th part, as segments are numbered without gaps."""
    long = rows.filter(F.col("seg_idx") >= block).select(F.col("video_id").alias("_long")).distinct()
    return rows.join(F.broadcast(long), F.col("video_id").eqNullSafe(F.col("_long")), "left_semi")


def _with_later(rows: DataFrame, later: DataFrame) -> DataFrame:
    """``rows`` (video_id, b, ...) with what ``later`` (video_id, b, ...) has for their block: a row for each block but a video's first."""
    other = later.withColumnsRenamed({"video_id": "_video", "b": "_b"})
    same = F.col("video_id").eqNullSafe(F.col("_video")) & (F.col("b") == F.col("_b"))
    return rows.join(F.broadcast(other), same, "left").drop("_video", "_b")


def _near_flagged(rows: DataFrame) -> DataFrame:
    """``rows`` (video_id, seg_idx, ..., flag) without those that aren't flagged and stand between two that aren't, so that these are not shuffled.

    Rows are looked at as they stand; one whose neighbours in the video don't stand beside it stays.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            video, idx, flag = (b.column(c).to_numpy(zero_copy_only=False) for c in ("video_id", "seg_idx", "flag"))
            flag = flag.astype(bool)
            follows = (video[1:] == video[:-1]) & (idx[1:] == idx[:-1] + 1)
            before = np.append(idx[0] == 0, (follows & ~flag[:-1]) | (idx[1:] == 0))
            after = np.append(follows & ~flag[1:], False)
            yield b.filter(pa.array(flag | ~before | ~after))

    return rows.mapInArrow(kept, rows.schema)


def question_windows(segments: DataFrame, max_gap: float = P.MERGE_GAP, block: int = BLOCK) -> DataFrame:
    """(video_id, segment_index, start, end, text): runs of flagged segments with a segment of context on each side.

    ``seg_idx`` counts from 0 without gaps. The segments at a border are guests of the block next to it, so each one sees
    its neighbours. A run is named by the segment that opens it; where that lies in an earlier block, it is the last
    one opened there, which is carried over the blocks. A run of any length is gathered in parts.
    """
    n, flag = F.col("seg_idx"), segment_has_candidate(F.col("text"))
    own = F.floor(n / block).cast("long")
    also = F.when((n % block == 0) & (n > 0), own - 1).when(n % block == block - 1, own + 1)
    where = F.array_compact(F.array(own, also, F.when(F.lit(block == 1), own + 1)))
    order = Window.partitionBy("video_id", "b").orderBy("seg_idx")

    def seen(segments: DataFrame) -> DataFrame:
        rows = _near_flagged(segments.select("video_id", "seg_idx", "start", "end", "text", flag.alias("flag")))
        return rows.select("*", own.alias("own"), F.explode(where).alias("b")).select(
            "*",
            F.lag("flag").over(order).alias("flag_before"),
            F.lag("end").over(order).alias("end_before"),
            F.lag("text").over(order).alias("text_before"),
            F.lead("text").over(order).alias("text_after"),
        )

    opens = F.col("flag") & (~F.coalesce("flag_before", F.lit(False)) | (F.col("start") - F.col("end_before") > max_gap))
    opened = lambda seen: seen.withColumn("opened", F.when(opens, n)).filter("own = b")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last_in_block = opened(seen(_of_long(segments, block))).groupBy("video_id", "b").agg(F.max("opened").alias("opened"))
    carry = _before(last_in_block, F.max("opened")).filter("carry IS NOT NULL")
    flagged = opened(seen(segments)).withColumn("run", F.max("opened").over(so_far)).filter("flag").drop("own", "opened", "flag", "flag_before", "end_before")
    named = _with_later(flagged, carry).withColumn("run", F.coalesce("run", "carry"))
    at = lambda f, c: f(c, "seg_idx").alias(c)
    texts = lambda c, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, c))), lambda x: x[c]), " ")
    parts = named.groupBy("video_id", "run", "b").agg(
        F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"), at(F.min_by, "start"), at(F.max_by, "end"), at(F.min_by, "text_before"), at(F.max_by, "text_after"),
        texts("text", "seg_idx").alias("text"),
    )
    whole = parts.groupBy("video_id", "run").agg(
        F.min("first").alias("segment_index"),
        F.min_by("start", "first").alias("start"),
        F.max_by("end", "last").alias("end"),
        F.array_join(F.array_compact(F.array(F.min_by("text_before", "first"), texts("text", "first"), F.max_by("text_after", "last"))), " ").alias("text"),
    )
    return whole.drop("run")


def exits(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of words that a chunk open at a block's beginning may hold (0: none is open) those open at its end, and the chunks opened in it.

    ``counts`` are the words of the block's segments. First for every place at which a chunk may begin, from the last to the first; then an entry is
    the place where its chunk is full.
    """
    m = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    longs = np.append(np.flatnonzero(counts > most), m)
    bound = longs[np.searchsorted(longs, np.arange(m + 1))]
    full = np.minimum(np.searchsorted(total, total + most, side="right") - 1, bound).tolist()
    left, opened, n, sums = [0] * (m + 1), [0] * (m + 1), counts.tolist(), total.tolist()
    for i in range(m - 1, -1, -1):
        if n[i] == 0:
            left[i], opened[i] = left[i + 1], opened[i + 1]
        elif n[i] > most:
            left[i], opened[i] = left[i + 1], opened[i + 1] + -(-n[i] // most)
        elif full[i] == m:
            left[i], opened[i] = sums[m] - sums[i], 1
        else:
            left[i], opened[i] = left[full[i]], opened[full[i]] + 1
    room = most - np.arange(most + 1)
    place = np.minimum(np.searchsorted(total, room, side="right") - 1, longs[0])
    place[0] = 0  # nothing is open
    through = (place == m) & (np.arange(most + 1) > 0)
    out = np.where(through, np.arange(most + 1) + sums[m], np.array(left)[place])
    return out, np.where(through, 0, np.array(opened)[place])


def passed(counts: np.ndarray, most: int, entry: int) -> tuple[int, int]:
    """The entry of ``exits`` for one number of words, by a search per chunk: those open at the block's end, and the chunks opened in it."""
    total = np.concatenate([[0], np.cumsum(counts)]).tolist()
    longs = [*np.flatnonzero(counts > most).tolist(), len(counts)]
    at, opened, w, long = 0, 0, entry, 0
    while at < len(counts):
        if at == longs[long]:
            w, opened, at, long = 0, opened - (-int(counts[at]) // most), at + 1, long + 1
            continue
        to = min(bisect_right(total, total[at] + most - w) - 1 if w else at, longs[long])
        if to > at:
            w, at = w + total[to] - total[at], to
        elif total[at + 1] == total[at]:
            at += 1
        else:  # what is open is full
            w, opened, at = total[at + 1] - total[at], opened + 1, at + 1
    return w, opened


def chunk_segments(segments: DataFrame, max_words: int = P.CHUNK_WORDS, block: int = BLOCK) -> DataFrame:
    """(video_id, chunk_id from 1, start, end, text, word_count): segments kept whole where they fit, as chunking.chunk_segments packs them.

    In videos of more than a block the word counts of each block, a row per block, are followed from the first block on, which tells every
    later block the chunks before, and its first segments that belong to a chunk opened before: these go to the block that opened it. Then all
    blocks are packed at once, after one shuffle. A split's blocks are gone through one after the other, so many short videos cost no call each.
    Rows without a video are dropped.
    """
    b = F.floor(F.col("seg_idx") / block).cast("long").alias("b")
    rows = segments.filter("video_id IS NOT NULL").select("video_id", b, "seg_idx", "start", "end", "text")
    words = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
    counts = _of_long(rows, block).groupBy("video_id", "b").agg(F.array_sort(F.collect_list(F.struct("seg_idx", words.alias("n")))).alias("s"))

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, w, c, home = None, 0, 0, 0
        for pdf in batches:
            out = []
            for own, at, idx, n in zip(pdf["video_id"], pdf["b"], pdf["seg_idx"], pdf["n"], strict=True):
                if own != video:
                    video, w, c, home = own, 0, 0, at
                n, head = np.asarray(n, np.int64), 0
                if w:
                    longs = np.append(np.flatnonzero(n > max_words), len(n))
                    head = min(int(np.searchsorted(np.cumsum(n), max_words - w, side="right")), int(longs[0]))
                out.append((own, at, home, idx[0] + head if head < len(n) else idx[-1] + 1, c))
                w, opened = passed(n, max_words, w)
                home, c = at if opened else home, c + opened
            yield pd.DataFrame(out, columns=["video_id", "b", "home", "upto", "opened"])

    placed = counts.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy("b")))
    later = placed.select("video_id", "b", F.col("s.seg_idx").alias("seg_idx"), F.col("s.n").alias("n"), "_n").mapInPandas(followed, "video_id string, b long, home long, upto int, opened int")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, start, end = pdf["text"].tolist(), pdf["start"].to_numpy(float), pdf["end"].to_numpy(float)
        ids, blocks, opened = (pdf[c].to_numpy() for c in ("video_id", "b", "opened"))
        out = []
        for x, y in itertools.pairwise(group_edges(ids, blocks).tolist()):
            out += [(ids[x], i, *c) for i, c in enumerate(pack(texts[x:y], start[x:y], end[x:y], max_words), int(opened[x]) + 1)]
        return pd.DataFrame(out, columns=["video_id", "chunk_id", "start", "end", "text", "word_count"])

    own = _with_later(rows, later.filter("b > 0")).withColumn("b", F.when(F.col("seg_idx") < F.col("upto"), F.col("home")).otherwise(F.col("b")))
    numbered = own.withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "b").orderBy("seg_idx")))
    dealt = numbered.select("video_id", "b", "start", "end", "text", F.coalesce("opened", F.lit(0)).alias("opened"), "_n")
    return dealt.mapInPandas(whole_groups(packed, ["video_id", "b"]), CHUNK)
