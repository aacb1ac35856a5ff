"""A stored index of chunk vectors with exact results: cells around pivots, and the triangle inequality to pass over them.

Vectors are taken at length 1, where the distance d between two has d^2 = 2 - 2 cos, so that nearest means most similar. A
vector lies in the cell of its nearest pivot, and its distance to the pivot is stored. A question's distance to a pivot bounds
those to all vectors of the cell; cells that can't hold one of the k nearest are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.operators import retrieval
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch

#: Vectors of a cell, about; pivots of a video at most; vectors of a video that pivots are chosen from, about.
CELL, MOST_PIVOTS, SAMPLE = 32, 2048, 8192
#: How far a bound may be off by rounding.
SLACK = 1e-6


def _units(rows: pd.DataFrame, column: str = "embedding") -> np.ndarray:
    v = np.stack(rows[column]).astype(float)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def choose_pivots(v: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``v`` that are far apart: each next one is the farthest from those before."""
    chosen, away = [0], _distances(v, v[:1])[:, 0]
    while len(chosen) < n and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def _nonzero(c: Column) -> Column:
    return F.exists(c, lambda x: x != 0)


def vector_cells(chunks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vectors, cells) of chunks (video_id, chunk_id, embedding): every vector that isn't zero in one cell; see SCHEMAS for their columns.

    Pivots are chosen from a sample of about SAMPLE vectors of a video, all vectors are then placed by blocks, so a
    video of any size goes to many tasks. Which pivots there are changes how much is looked at, never what is found.
    """
    rows = chunks.filter("video_id IS NOT NULL AND chunk_id IS NOT NULL").filter(F.coalesce(_nonzero(F.col("embedding")), F.lit(False))).select("video_id", "chunk_id", "embedding")
    sizes = scratch(rows.groupBy("video_id").agg(F.count("*").alias("_n"), F.min(F.xxhash64("chunk_id")).alias("_least")))
    rows = rows.join(sizes, "video_id")
    place = F.xxhash64("chunk_id")
    drawn = rows.filter((F.pmod(place, F.lit(1 << 20)) * F.col("_n") < F.lit(SAMPLE << 20)) | (place == F.col("_least")))

    def pivots(rows: pd.DataFrame) -> pd.DataFrame:
        n = min(MOST_PIVOTS, -(-int(rows["_n"].iloc[0]) // CELL))
        found = choose_pivots(_units(rows.sort_values("chunk_id")), n)
        return pd.DataFrame({"video_id": rows["video_id"].iloc[0], "cell": np.arange(len(found)), "pivot": list(found)})

    chosen = scratch(drawn.groupBy("video_id").applyInPandas(pivots, "video_id string, cell int, pivot array<double>"))

    def placed(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["video_id", "chunk_id", "cell", "distance", "embedding"])
        around = around.sort_values("cell")
        d = _distances(_units(own), np.stack(around["pivot"]))
        at = d.argmin(axis=1)
        return pd.DataFrame({"video_id": own["video_id"], "chunk_id": own["chunk_id"], "cell": at.astype(np.int32), "distance": d[np.arange(len(at)), at], "embedding": own["embedding"]})

    blocks = F.ceil(F.col("_n") / retrieval.BLOCK).cast("int")
    dealt = rows.select("video_id", "chunk_id", "embedding", F.pmod(place, blocks).cast("int").alias("b")).groupBy("video_id", "b")
    every = chosen.join(sizes, "video_id").withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).select("video_id", "cell", "pivot", "b").groupBy("video_id", "b")
    vectors = scratch(dealt.cogroup(every).applyInPandas(placed, "video_id string, chunk_id int, cell int, distance double, embedding array<float>"))
    spans = vectors.groupBy("video_id", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    return vectors, spans.join(chosen, ["video_id", "cell"])


def save_vectors(chunks: DataFrame, folder: str, ids: DataFrame | None = None) -> None:
    """Indexes the vectors of ``chunks`` in the folder's tables vectors and cells, in place of what they have of the videos ``ids`` (by default those of the chunks)."""
    with Scratch(chunks.sparkSession) as scratch:
        vectors, cells = vector_cells(chunks, scratch)
        ids = scratch((chunks if ids is None else ids).select("video_id").distinct())
        tables.replace_buckets(vectors, folder, "vectors", ids, scratch)
        tables.replace_buckets(cells, folder, "cells", ids, scratch)


def cells_to_look_at(questions: DataFrame, cells: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """(question_id, video_id, cell, n): the cells of a question's video that may hold one of its k nearest vectors.

    A question's k nearest are no farther than the cells of k vectors reach at most; a cell that begins farther away is left out.
    """

    def near(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(columns=["question_id", "video_id", "cell", "n"])
        d = _distances(_units(q), np.stack(c["pivot"]))
        n, low, high = (c[x].to_numpy(float) for x in ("n", "nearest", "farthest"))
        most = d + high
        order = np.argsort(most, axis=1)
        enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
        reach = most[np.arange(len(q)), order[np.arange(len(q)), enough]]
        if n.sum() < k:
            reach[:] = np.inf
        least = np.maximum(np.maximum(d - high, low - d), 0.0)
        row, at = np.nonzero(least <= reach[:, None] + SLACK)
        return pd.DataFrame({"question_id": q["question_id"].to_numpy()[row], "video_id": key[0], "cell": c["cell"].to_numpy()[at], "n": c["n"].to_numpy()[at]})

    asked = questions.filter(F.coalesce(_nonzero(F.col("embedding")), F.lit(False))).select("question_id", "video_id", "embedding")
    blocks = asked.groupBy("video_id").agg(F.ceil(F.count("*") / retrieval.BLOCK).cast("int").alias("_nq"))
    left = asked.join(blocks, "video_id").withColumn("b", F.pmod(F.xxhash64("question_id"), F.col("_nq")).cast("int")).drop("_nq").groupBy("video_id", "b")
    right = cells.join(blocks, "video_id").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq").groupBy("video_id", "b")
    kind = dict(questions.dtypes)["question_id"]
    return left.cogroup(right).applyInPandas(near, f"question_id {kind}, video_id string, cell int, n long")


def retrieve_indexed(questions: DataFrame, vectors: DataFrame, cells: DataFrame, chunks: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """The rows of retrieve_chunks, from the vectors of those cells alone that may hold one of a question's k nearest.

    A cell that many questions look at, and a large one, go to many tasks, in blocks.
    """
    look = cells_to_look_at(questions, cells, k)
    name = F.concat_ws("#", "video_id", F.col("cell").cast("string")).alias("video_id")
    asked = look.select("question_id", "video_id", "cell").join(questions.select("question_id", "embedding"), "question_id").select("question_id", name, "embedding")
    found = retrieval.best_of_blocks(asked, vectors.select(name, "chunk_id", "embedding"), k)
    found = found.withColumn("video_id", F.regexp_replace("video_id", "#[0-9]+$", ""))
    return retrieval.with_chunks(retrieval.best(found, k), chunks)


def looked_at(questions: DataFrame, cells: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """(vectors, of, share): the vectors that the questions look at, of those that all pairs would be, in one row."""
    seen = cells_to_look_at(questions, cells, k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
    sizes = cells.groupBy("video_id").agg(F.sum("n").alias("n"))
    every = questions.join(sizes, "video_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of"))
    return seen.join(every, F.lit(True)).select("vectors", "of", F.try_divide("vectors", "of").alias("share"))
