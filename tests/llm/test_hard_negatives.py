"""Hard negatives against brute force: every kind of odd row, ties, many blocks, scores beyond a double's whole numbers."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from transcript_jobs.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, anchor=lambda k: k % 100 == 0, positives=5, negatives=10, least=30, most=90):
    """Rows (vec_id, embedding, label) -> sorted result, pair by pair."""
    good = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for a in (r for r in good if anchor(r[0])):
        score = lambda r: max(-(2**63), min(2**63 - 1, sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a[1], r[1], strict=True))))  # noqa: B023, E731
        ranked = sorted(((-score(r), r[0], r[2]) for r in good if len(r[1]) == len(a[1])))
        for s, k, _ in [x for x in ranked if x[2] == a[2] and x[1] != a[0]][:positives]:
            fit = [x for x in ranked if x[2] != a[2] and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(a[0], k, i, x[1], -s, -x[0]) for i, x in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, anchor=lambda k: k % 100 == 0, **more):
    got = N.mine(spark.createDataFrame(rows, SCHEMA), anchor, **more).collect()
    return sorted(tuple(r) for r in got)


def made(n, dims=5, seed=3, scale=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(scale * r.normal(size=dims), 2)], "abc"[int(r.integers(3))]) for i in range(n)]


def test_odd_rows(spark):
    rows = made(240, dims=3)
    rows += rows[:9] + [rows[100]] * 3  # repeated rows, an anchor among them
    rows += [(100, rows[5][1], "b"), (200, rows[6][1], "zz")]  # a key with another vector, a label of its own
    rows += [(300, None, "a"), (301, [1.0, None, 2.0], "a"), (302, [1.0, float("nan"), 0.0], "b"), (303, [float("-inf"), 0.0, 0.0], "c"), (304, [1.0, 2.0, 3.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], "a"), (400, [], "a"), (401, [], "a"), (402, [], "b"), (500, [1.0, 2.0], "a"), (501, [1.0, 2.5], "a"), (502, [1.0, 1.0], "b")]
    want = brute(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} >= {0, 100, 200, 400, 500}


def test_ties_and_one_hot_label(spark):
    rows = [(i, [1.0, float(i % 3)], "hot" if i % 10 else "b") for i in range(300)]
    every = lambda k: k % 20 == 0
    assert mined(spark, rows, every) == brute(rows, every)


@pytest.mark.parametrize("scale", [1e6, 1e13, 1e300])
def test_large_components(spark, scale):
    """Scores that a double can't hold exactly, and those beyond a long."""
    rows = made(60, dims=4, scale=scale)
    every = lambda k: k % 7 == 0
    assert mined(spark, rows, every) == brute(rows, every)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 2)
    monkeypatch.setattr(N, "CELL_ANCHORS", 3)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 2)
    rows = made(150)
    every = lambda k: k % 9 == 0
    assert mined(spark, rows, every, positives=2, negatives=3) == brute(rows, every, 2, 3)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] and mined(spark, made(50), lambda k: k < 0) == []
    assert mined(spark, [(0, [1.0], "a")]) == []


def test_clashing_columns(spark):
    rows = made(120)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in "a id v p slot anchor down across rank positive_id a.dot".split()})
    df = df.select("*", F.lit("x").alias("Label"), F.lit("y").alias("VEC_ID"))
    assert sorted(tuple(r) for r in N.mine(df, lambda k: k % 100 == 0).collect()) == brute(rows)


def test_query(spark):
    """The query over the whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(k, v, (x + 1) % 10 if k % 7 == 0 and x is not None else x) for k, v, x in rows]
    got = sorted(tuple(r) for r in N.query(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(moved)


def test_limits_and_order():
    for p in [*range(-130, 260), 2**63 - 1, -(2**63), 10**18 + 7]:
        low, high = (int(x) for x in N.limits(np.array(p)))
        assert 100 * (low - 1) < 30 * p <= 100 * low and 100 * high <= 90 * p < 100 * (high + 1)
    rng = np.random.default_rng(5)
    for own in (rng.integers(-3, 4, (5, 40)), np.array([[2**63 - 1, -(2**63), 0, 2**63 - 1, -(2**63)]])):
        assert [sorted(range(own.shape[1]), key=lambda i: (-int(r[i]), i)) for r in own] == N.by_score(own).tolist()  # noqa: B023
