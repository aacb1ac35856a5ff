"""The stored index finds what looking at every vector finds, and looks at few of them where they are clustered."""

import numpy as np
import pytest

from transcript_jobs.operators import retrieval, vector_index
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch

CHUNK = "video_id string, chunk_id int, start double, end double, text string, embedding array<double>"


def chunks_of(spark, vectors):
    return spark.createDataFrame([(v, i, 0.0, 1.0, "t", [float(x) for x in e]) for v, i, e in vectors], CHUNK)


def questions_of(spark, vectors):
    return spark.createDataFrame([(i, v, [float(x) for x in e]) for i, (v, e) in enumerate(vectors)], "question_id long, video_id string, embedding array<double>")


def clustered(n, clusters, dims=16, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dims))
    return centers[r.integers(clusters, size=n)] + 0.1 * r.normal(size=(n, dims))


def found(df):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], r["similarity"], r["video_id"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_same_rows(spark, monkeypatch, k):
    """Ties, zero vectors, repeated vectors, small videos, unknown videos; several cells and blocks."""
    monkeypatch.setattr(vector_index, "CELL", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    r = np.random.default_rng(2)
    v = [("a", i, e) for i, e in enumerate(np.round(clustered(90, 6, 4), 1))] + [("b", i, r.integers(-1, 2, 4)) for i in range(40)] + [("c", 1, [1, 0, 0, 0]), ("d", 1, [0, 0, 0, 0]), ("e", 7, [1, 1, 0, 0]), ("e", 8, [1, 1, 0, 0])]
    q = [("a", e) for e in clustered(20, 6, 4)] + [("b", r.integers(-1, 2, 4)) for _ in range(20)] + [("c", [1, 2, 0, 0]), ("d", [1, 0, 0, 0]), ("e", [1, 0, 0, 0]), ("z", [1, 0, 0, 0]), ("a", [0, 0, 0, 0])]
    chunks, questions = chunks_of(spark, v), questions_of(spark, q)
    with Scratch(spark) as scratch:
        vectors, cells = vector_index.vector_cells(chunks, scratch)
        assert vectors.count() == sum(any(e) for *_, e in v)
        assert found(vector_index.retrieve_indexed(questions, vectors, cells, chunks, k)) == found(retrieval.retrieve_chunks(questions, chunks, k))


def test_few_are_looked_at(spark, tmp_path):
    """Below a fifth of all vectors on clustered data; every vector is indexed; a video is replaced."""
    v = [("a", i, e) for i, e in enumerate(clustered(4000, 40))] + [("b", i, e) for i, e in enumerate(clustered(600, 10, seed=3))]
    chunks = chunks_of(spark, v)
    r = np.random.default_rng(4)
    q = [(x, e + 0.05 * r.normal(size=16)) for x, _, e in v[::40]]
    questions = questions_of(spark, q)
    vector_index.save_vectors(chunks, str(tmp_path))
    vectors, cells = (tables.load_table(spark, str(tmp_path), t) for t in ("vectors", "cells"))
    seen = vector_index.looked_at(questions, cells).head()
    assert vectors.count() == 4600 and seen["of"] == sum(4000 if x == "a" else 600 for x, _ in q) and 0 < seen["share"] < 0.2
    assert found(vector_index.retrieve_indexed(questions, vectors, cells, chunks)) == found(retrieval.retrieve_chunks_blocked(questions, chunks))
    vector_index.save_vectors(chunks.filter("video_id = 'b' AND chunk_id < 9"), str(tmp_path))
    assert {r["video_id"]: r["count"] for r in tables.load_table(spark, str(tmp_path), "vectors").groupBy("video_id").count().collect()} == {"a": 4000, "b": 9}
    assert vector_index.looked_at(questions.limit(0), cells).head()["share"] is None


def test_bounds_hold(spark):
    """No vector of a cell is nearer to a question, or farther from it, than its bounds tell."""
    v = clustered(500, 12)
    chunks = chunks_of(spark, [("a", i, e) for i, e in enumerate(v)])
    with Scratch(spark) as scratch:
        vectors, cells = (df.toPandas() for df in vector_index.vector_cells(chunks, scratch))
    q = clustered(30, 12, seed=9)
    q /= np.linalg.norm(q, axis=1)[:, None]
    for c in cells.itertuples():
        own = np.stack(vectors.loc[vectors.cell == c.cell, "embedding"]).astype(float)
        own /= np.linalg.norm(own, axis=1)[:, None]
        d, p = np.linalg.norm(q[:, None] - own[None], axis=2), np.linalg.norm(q - np.array(c.pivot), axis=1)
        assert len(own) == c.n and (d.max(axis=1) <= p + c.farthest + 1e-6).all() and (d.min(axis=1) >= np.maximum(p - c.farthest, c.nearest - p) - 1e-6).all()
