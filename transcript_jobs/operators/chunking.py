"""Greedy packing of whole segments into chunks of bounded words."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P

CHUNK = "video_id string, chunk_id int, start double, end double, text string, word_count int"


def pack(texts: list[str], start: np.ndarray, end: np.ndarray, most: int) -> list[tuple]:
    """(start, end, text, words) of the chunks of one video: a search per chunk in the running word counts."""
    counts = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    total = np.concatenate([[0], np.cumsum(counts)])
    long = np.append(np.flatnonzero(counts > most), len(counts))
    out, i = [], 0
    while i < len(counts):
        if counts[i] > most:
            w, span = texts[i].split(" "), end[i] - start[i]
            for a in range(0, len(w), most):
                b = min(a + most, len(w))
                out.append((start[i] + span * (a / len(w)), start[i] + span * (b / len(w)), " ".join(w[a:b]), b - a))
            i += 1
            continue
        # as many segments as fit, up to the next one that must be cut
        j = min(int(np.searchsorted(total, total[i] + most, side="right")) - 1, int(long[np.searchsorted(long, i)]))
        if counts[i:j].sum():
            own = [k for k in range(i, j) if counts[k]]
            out.append((start[own[0]], end[own[-1]], " ".join(texts[k] for k in own), int(total[j] - total[i])))
        i = max(j, i + 1)
    return out


def group_edges(*keys: np.ndarray) -> np.ndarray:
    """Places at which a group of rows with the same keys begins, and the number of rows."""
    n = len(keys[0])
    changes = np.zeros(max(0, n - 1), bool)
    for k in keys:
        changes |= k[1:] != k[:-1]
    return np.concatenate([[0] if n else [], np.flatnonzero(changes) + 1, [n]]).astype(int)


def by_video(rows: DataFrame, order: list[str], pack: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``pack`` over each video's rows in order: a split holds many videos, which it goes through one after the other.

    ``pack`` gets whole videos, as many at once as a batch brings, sorted by video and ``order``. They are brought
    together by a row number over each video, which uses the partitioning by video that rows may have already.
    """
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return rows.withColumn("_n", n).mapInPandas(whole_groups(pack, ["video_id"]), schema)


def whole_groups(pack: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows that are sorted by ``keys``: ``pack`` gets whole groups, as many at once as a batch brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            edges = group_edges(*(b[k].to_numpy() for k in keys))
            same = held and all(held[-1][k].iloc[-1] == b[k].iloc[0] for k in keys)
            if same and len(edges) == 2:
                held.append(b)
                continue
            last = int(edges[-2])
            done = pd.concat([*held, b.iloc[:last]], ignore_index=True)
            if len(done):
                yield pack(done)
            held = [b.iloc[last:]]
        if held:
            yield pack(pd.concat(held, ignore_index=True))

    return run


def chunk_segments(segments: DataFrame, max_words: int = P.CHUNK_WORDS) -> DataFrame:
    """(video_id, chunk_id from 1, start, end, text, word_count): segments kept whole where they fit.

    A segment of more than ``max_words`` closes the open chunk and is cut at words, its time shared by word
    position. Packing is sequential within a video (a day of speech is about 10^5 segments; long_videos has videos
    of any length); a split's videos are packed one after the other, so many short ones cost no call each. Rows without a video are dropped.
    """

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts = rows["video_id"].to_numpy(), rows["text"].tolist()
        start, end = rows["start"].to_numpy(float), rows["end"].to_numpy(float)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in itertools.pairwise(edges):
            own = pack(texts[a:b], start[a:b], end[a:b], max_words)
            out += [(ids[a], i, *c) for i, c in enumerate(own, 1)]
        return pd.DataFrame(out, columns=["video_id", "chunk_id", "start", "end", "text", "word_count"])

    rows = segments.filter("video_id IS NOT NULL").select("video_id", "seg_idx", "start", "end", "text")
    return by_video(rows, ["seg_idx"], packed, CHUNK)
