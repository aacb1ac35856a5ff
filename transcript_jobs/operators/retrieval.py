"""Exact nearest chunks within a question's own video."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.text import words

#: Chunks of a video that one task compares at once with as many questions; questions whose products are summed at once.
BLOCK, TILE = 1024, 128


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles, filled up with zeros, their sizes); the size is -1 where a vector is null or has a null."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = -1
    sizes[row[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes


def cosines(q: pa.ChunkedArray, c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, known) of every vector of q (rows) and of c (columns), in double; none is known where one is null, zero or of another size.

    Products are summed place by place, as an engine does that goes through two lists: the order of the sum is that of
    the vectors whatever the block is, so equal vectors have equal similarities, and ties stay ties.
    """
    (a, n), (b, m) = _matrix(q), _matrix(c)
    places, across = min(a.shape[1], b.shape[1]), np.ascontiguousarray(b.T)
    out, part = np.zeros((len(a), len(b))), np.empty((TILE, len(b)))
    squares = lambda v: np.add.accumulate(v * v, axis=1)[:, -1] if v.shape[1] else np.zeros(len(v))
    with np.errstate(all="ignore"):
        for x in range(0, len(a), TILE):
            own = a[x : x + TILE]
            for d in range(places):
                np.multiply.outer(own[:, d], across[d], out=part[: len(own)])
                out[x : x + TILE] += part[: len(own)]
        lengths = np.sqrt(squares(a))[:, None] * np.sqrt(squares(b))[None, :]
        known = (n[:, None] == m[None, :]) & (n >= 0)[:, None] & (lengths != 0)
        return np.divide(out, lengths, out=out), known


def _by_blocks(questions: DataFrame, chunks: DataFrame, found: Callable[[pa.Table, pa.Table], tuple]) -> DataFrame:
    """(question_id, video_id, chunk_id, similarity): of every block of questions and of chunks of their video, the pairs that ``found`` gives.

    ``found`` returns places in the questions and in the chunks, and similarities. Only chunks of videos that are asked about are
    compared. Both sides are dealt into blocks of about BLOCK rows by their counts, and each block of questions meets each of chunks.
    """
    kind = lambda df, c: dict(df.dtypes)[c]
    schema = f"question_id {kind(questions, 'question_id')}, video_id string, chunk_id {kind(chunks, 'chunk_id')}, similarity double"

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        row, at, s = found(q, c) if len(q) and len(c) else ([], [], [])
        ids = [q["question_id"].take(pa.array(row, pa.int64())), q["video_id"].take(pa.array(row, pa.int64())), c["chunk_id"].take(pa.array(at, pa.int64()))]
        return pa.table([*ids, pa.array(s, pa.float64())], names=["question_id", "video_id", "chunk_id", "similarity"])

    count = lambda df, name: df.groupBy("video_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = count(questions, "_nq").join(count(chunks, "_nc"), "video_id")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = questions.select("question_id", "video_id", "embedding").join(blocks, "video_id").withColumn("_qb", deal("question_id", "_nq")).withColumn("_cb", every("_nc"))
    own = chunks.select("video_id", "chunk_id", "embedding").join(blocks, "video_id").withColumn("_cb", deal("chunk_id", "_nc")).withColumn("_qb", every("_nq"))
    by = ["video_id", "_cb", "_qb"]
    pairs = asked.select(*by, "question_id", "embedding").groupBy(*by).cogroup(own.select(*by, "chunk_id", "embedding").groupBy(*by))
    return pairs.applyInArrow(run, schema)


def question_chunk_pairs(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, video_id, chunk_id, similarity): every chunk of the question's video, and of no other; NULL if a vector is null or zero.

    The rows are all pairs, so they grow with the product of a video's questions and chunks; a task holds a block of BLOCK by BLOCK of them.
    """

    def found(q: pa.Table, c: pa.Table) -> tuple:
        s, known = cosines(q["embedding"], c["embedding"])
        row, at = np.divmod(np.arange(s.size), s.shape[1])
        return row, at, pa.array(s.ravel(), pa.float64(), mask=~known.ravel())

    return _by_blocks(questions, chunks, found)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """Each question's k nearest with their ``rank``, ties by chunk_id; similarities are rounded after that."""
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id")
    ranked = pairs.filter("similarity IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", P.DIGITS))


def with_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts and times join the winners only."""
    return found.join(chunks.select("video_id", "chunk_id", "start", "end", "text"), ["video_id", "chunk_id"])


def best_of_blocks(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, video_id, chunk_id, similarity): of each block of chunks the k nearest to a question of their video."""

    def found(q: pa.Table, c: pa.Table) -> tuple:
        s, known = cosines(q["embedding"], c["embedding"])
        ids = c["chunk_id"].to_numpy()
        order = np.where(known, np.where(np.isnan(s), np.inf, s), -np.inf)  # NaN is the largest, as to Spark
        if len(ids) > k:  # all that reach the k-th best, then ties by chunk_id
            known &= order >= -np.partition(-order, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero(known)
        place = np.lexsort((ids[at], -order[row, at], row))
        row, at = row[place], at[place]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[first], at[first], s[row[first], at[first]]

    return _by_blocks(questions, chunks, found)


def retrieve_chunks(questions: DataFrame, chunks: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """(video_id, chunk_id, question_id, similarity, rank, start, end, text): each question's k nearest, ties by chunk_id.

    A popular video's questions and chunks go to many tasks, in blocks of each; vectors stay out of the ranking shuffle.
    """
    return with_chunks(best(best_of_blocks(questions, chunks, k), k), chunks)


retrieve_chunks_blocked = retrieve_chunks


def relevant_chunks(retrieved: DataFrame, threshold: float = P.SIMILARITY) -> DataFrame:
    """Those whose rounded similarity reaches the threshold, after the top k."""
    return retrieved.filter(F.col("similarity") >= threshold)


def fit_word_budget(retrieved: DataFrame, max_words: int = P.CONTEXT_WORDS) -> DataFrame:
    """(question_id, video_id, chunks): best first, each that still fits; one that doesn't is passed over.

    The best is always kept, cut to the budget. A fold over the top k of a question.
    """
    c = F.struct("rank", "chunk_id", "start", "end", "similarity", words(F.col("text")).alias("w"))
    grouped = retrieved.groupBy("question_id", "video_id").agg(F.array_sort(F.collect_list(c)).alias("cs"))
    item = lambda x: F.struct(
        x["chunk_id"].alias("chunk_id"), x["start"].alias("start"), x["end"].alias("end"), x["similarity"].alias("similarity"),
        F.array_join(F.slice(x["w"], 1, max_words), " ").alias("text"),
    )
    none = F.filter(F.transform("cs", item), lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        n = F.least(F.size(x["w"]), F.lit(max_words))
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + F.size(x["w"]) <= max_words)
        return F.when(fits, F.struct((acc["used"] + n).alias("used"), F.concat(acc["kept"], F.array(item(x))).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("used"), none.alias("kept"))
    return grouped.select("question_id", "video_id", F.aggregate("cs", start, step, lambda acc: acc["kept"]).alias("chunks"))
