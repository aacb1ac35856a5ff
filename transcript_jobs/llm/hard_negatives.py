"""Hard negatives by full score sorts: anchors meet all rows in cells of a grid, each cell sorts its scores, and the cells' firsts are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, Scratch, table

#: A component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows and anchors of a cell, about, and blocks of rows at least; a cell's scores are sorted for so many pairs at once.
CELL_ROWS, CELL_ANCHORS, LEAST_BLOCKS = 1 << 18, 1 << 16, 64
PAIRS_AT_ONCE = 1 << 21
_LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), F.lit(False))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as longs; beyond a long's range they are its ends."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[min(max(int(x), _LONG.min), _LONG.max) for x in r] for r in exact], np.int64).reshape(exact.shape)


def by_score(own: np.ndarray) -> np.ndarray:
    """Per row of ``own`` the columns by falling score, then by column: what a lexsort by (score, id) gives where columns are in the order of their ids."""
    n = own.shape[1]
    high, low = int(own.max(initial=0)), int(own.min(initial=0))
    if (high - low + 1) * max(n, 1) < 2**62:  # both keys fit in one number, and plain sorts are the fastest
        key = (high - own) * n + np.arange(n)
        key.sort(axis=1)
        return key % n
    return np.lexsort((np.broadcast_to(np.arange(n), own.shape), ~own), axis=1)  # ~x falls as x rises, for every long


def limits(positive: np.ndarray, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score n with least * p <= 100 * n <= most * p; no product leaves a long's range."""
    tens, rest = positive // 100, positive % 100
    return least * tens - (-(least * rest) // 100), most * tens + most * rest // 100


def band(falling: np.ndarray, positive: np.ndarray, k: int, least: int = LEAST_PERCENT, most: int = MOST_PERCENT) -> list[tuple[int, int]]:
    """For each positive score the places (from, to) of the first ``k`` of the falling scores within its limits."""
    low, high = limits(positive, least, most)
    rising = falling[::-1]
    n = len(falling)
    first = n - np.searchsorted(rising, high, side="right")
    end = n - np.searchsorted(rising, low, side="left")
    return [(a, max(a, min(e, a + k))) for a, e in zip(first.tolist(), end.tolist(), strict=True)]


def _matrix(vectors: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Whole components, as doubles, of the vectors (of one length) at the places ``at``."""
    own = pc.take(vectors, pa.array(at)).combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    return np.floor(SCALE * own.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(at), -1)


def _like(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Per length of vector: the anchors' places, labels and matrix, and the rows' ids (rising), labels and matrix; labels as numbers."""
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    both = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks], anchors["label"].type)
    labels = both.unique()
    own, others = (pc.index_in(t["label"], labels).to_numpy() for t in (anchors, rows))
    anchor_length, row_length = (pc.list_value_length(t["v"]).to_numpy() for t in (anchors, rows))
    for length in np.unique(anchor_length):
        at, here = np.flatnonzero(anchor_length == length), order[row_length[order] == length]
        if len(here):
            yield at, own[at], _matrix(anchors["v"], at), rows["id"].to_numpy()[here], others[here], _matrix(rows["v"], here)


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """A cell's first ``k`` other rows of each anchor's label."""
    out: list[tuple] = []
    names, ids_of = anchors["a"].to_numpy(), anchors["id"].to_numpy()
    for at, own, vectors, ids, labels, matrix in _like(anchors, rows):
        by_label = np.argsort(labels, kind="stable")
        for label in np.unique(own):
            mine_, x, y = np.flatnonzero(own == label), *np.searchsorted(labels[by_label], [label, label + 1])
            same = by_label[x:y]
            step = max(1, PAIRS_AT_ONCE // max(1, len(same)))
            for b in range(0, len(mine_), step):
                i = mine_[b : b + step]
                part = scores(vectors[i], matrix[same])
                for j, score, order in zip(at[i].tolist(), part, by_score(part), strict=True):
                    order = order[ids[same[order]] != ids_of[j]][:k]
                    out.append((np.full(len(order), names[j]), ids[same[order]], score[order]))
    return _table(out, ["a", "positive_id", "positive_score"])


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, least: int, most: int) -> pa.Table:
    """A cell's first ``k`` rows of another label in the band of each anchor's positives."""
    out: list[tuple] = []
    names, of = anchors["a"].to_numpy(), anchors["p"].to_pylist()
    for at, own, vectors, ids, labels, matrix in _like(anchors, rows):
        step = max(1, PAIRS_AT_ONCE // len(ids))
        for b in range(0, len(at), step):
            part = scores(vectors[b : b + step], matrix)
            for j, label, score, order in zip(at[b : b + step].tolist(), own[b : b + step].tolist(), part, by_score(part), strict=True):
                order = order[labels[order] != label]
                falling = score[order]
                positives = np.array([p["positive_score"] for p in of[j]], np.int64)
                for p, (x, y) in zip(of[j], band(falling, positives, k, least, most), strict=True):
                    same_for = [np.full(y - x, v) for v in (names[j], p["slot"], p["positive_id"], p["positive_score"])]
                    out.append((*same_for, ids[order[x:y]], falling[x:y]))
    return _table(out, ["a", "slot", "positive_id", "positive_score", "negative_id", "negative_score"])


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.array([], np.int64)] * len(names)
    return pa.table(dict(zip(names, columns, strict=True)))


def mine(
    rows: DataFrame, is_anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    ``is_anchor`` is a condition on a key. Scores are exact inner products of whole components.
    Positives are the anchor's first rows of its label with another key; negatives the first rows of another label
    within the limits of the positive's score. Higher scores come first, then smaller keys.

    Rows and anchors are dealt over a grid; a cell holds CELL_ROWS by CELL_ANCHORS at most, whatever their labels,
    and gives so many rows per anchor as are asked for. So no label, vector or key makes a task longer, and all pairs
    are scored but never made rows.

    Rows without key, label or vector, and with a component that is null or not finite, take no part. Vectors of
    different lengths have no score. A repeated row counts as often as it is there, as anchor too, and none of the rows
    with an anchor's key is its positive. A score beyond a long is its nearest end. Other columns are left aside;
    an empty table, or one without anchors, gives no rows. ``key`` is a whole number.
    """
    spark = rows.sparkSession
    own = Aside(rows)
    good = own.df.select(own(key).cast("long").alias("id"), own(label).alias("label"), own(vector).alias("v"))
    good = good.withColumn("anchor", F.coalesce(is_anchor(F.col("id")), F.lit(False))).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    kept = Scratch(spark, "negatives")
    anchors = kept.put(good.filter("anchor").select(F.monotonically_increasing_id().alias("a"), "id", "label", "v"), "anchors")
    n, m = good.count(), anchors.count()
    down, across = max(LEAST_BLOCKS, -(-n // CELL_ROWS)), max(1, -(-m // CELL_ANCHORS))
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(down)).cast("int")  # rows with one key are spread too
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = good.select("id", "label", "v", block.alias("down")).withColumn("across", every(across)).groupBy("down", "across")
    left = lambda df: df.withColumn("across", F.pmod(F.xxhash64("a"), F.lit(across)).cast("int")).withColumn("down", every(down)).groupBy("down", "across")

    best = left(anchors).cogroup(right).applyInArrow(lambda a, b: _positives(a, b, positives), "a long, positive_id long, positive_score long")
    order = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= positives)
    best = kept.put(best.groupBy("a").agg(F.collect_list(F.struct("slot", "positive_id", "positive_score")).alias("p")), "positives")

    asked = anchors.join(best, "a")
    schema = "a long, slot long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = left(asked).cogroup(right).applyInArrow(lambda a, b: _negatives(a, b, negatives, least, most), schema)
    order = Window.partitionBy("a", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.join(anchors.select("a", F.col("id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", moved), lambda k: k % 100 == 0)


SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, own, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS slot
  FROM s WHERE label = own AND id <> anchor_id QUALIFY slot <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, slot ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}"""
