"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made in Arrow batches where the texts are read, nothing is shuffled but the labels; the trees are
trained on a bounded sample on the driver and sent to the tasks as a few flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, table, text_or_empty
from transcript_jobs.llm.labelled import held_out, sample

#: Labelled rows that the trees are trained on, at most.
SAMPLE_ROWS = 20_000
ACCEPT = 0.5
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 60, 4, 64, 0.2, 2.0, 1.0

#: Byte classes whose shares are statistics; a byte of a multi-byte character counts as "beyond".
CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "stop": b".!?",
    "loud": b"!",
    "comma": b",;:",
    "bracket": b"()[]{}/\\=_~^@+",
    "beyond": bytes(range(128, 256)),
    "line": b"\n",
}
_WEIGHTS = np.array([[b in chars for chars in CLASSES.values()] for b in range(256)], float)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
STATISTICS = [f"share_{c}" for c in CLASSES] + [
    "log_words", "word_length", "word_spread", "distinct_words", "same_as_last", "distinct_lines", "words_per_line", "longest_word",
]


def statistics(text: str) -> np.ndarray:
    """The STATISTICS of a whole text; of an empty one, zeros."""
    out = np.zeros(len(STATISTICS))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(raw, minlength=256)
    solid = max(1, int(counts[~_WHITE].sum()))
    k = len(CLASSES)
    out[:k] = counts @ _WEIGHTS / solid
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    same = sum(map(str.__eq__, words, words[1:]))
    out[k:] = (
        np.log1p(len(words)), sizes.mean(), sizes.std(), len(set(words)) / len(words) * min(1.0, len(words) / 50),
        same / len(words), len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), np.log1p(sizes.max()),
    )
    return out


@dataclass
class Trees:
    """Boosted trees as arrays of (tree, node): go left where the statistic is at most the threshold; a leaf is its own child."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The likelihood of label 1 of each row: all trees and rows step down one level at a time."""
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            goes_left = x[row, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(goes_left, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss, splits searched in histograms of BINS bins. One class or no rows: its prior."""
    p = np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    empty = np.zeros((0, 1))
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, empty, empty, empty, empty, empty)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    cells = bins + np.arange(x.shape[1]) * BINS
    size = 2 ** (DEPTH + 1) - 1
    made: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    f = np.full(len(y), base)
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-f))
        g, h = prob - y, prob * (1 - prob)
        one = {"feature": np.zeros(size, np.int64), "threshold": np.full(size, np.inf), "left": np.arange(size), "right": np.arange(size), "value": np.zeros(size)}
        node = np.zeros(len(y), np.int64)
        for n in range(size):
            own = np.flatnonzero(node == n)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            one["value"][n] = -RATE * gs / (hs + RIDGE)
            if n >= size // 2:
                continue
            at = cells[own].ravel()
            reps = np.repeat(own, x.shape[1])
            gl = np.cumsum(np.bincount(at, g[reps], x.shape[1] * BINS).reshape(-1, BINS), axis=1)
            hl = np.cumsum(np.bincount(at, h[reps], x.shape[1] * BINS).reshape(-1, BINS), axis=1)
            gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (hs - hl < LEAST_HESSIAN)] = 0
            j, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                continue
            one["feature"][n], one["threshold"][n] = j, edges[j][b]
            one["left"][n], one["right"][n] = 2 * n + 1, 2 * n + 2
            node[own] = np.where(bins[own, j] <= b, 2 * n + 1, 2 * n + 2)
        f += one["value"][node]
        for k, v in one.items():
            made[k].append(v)
    return Trees(base, *(np.stack(made[k]) for k in ("feature", "threshold", "left", "right", "value")))


def _with_statistics(docs: DataFrame, schema: str, out) -> DataFrame:
    """mapInPandas over (k, t): ``out`` makes the result of a batch and its matrix of statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield out(b, np.stack([statistics(t) for t in b["t"]]))

    return docs.mapInPandas(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees trained on at most ``rows`` labelled documents; only their statistics reach the driver. Of rows with one key, one is taken."""
    chosen = F.broadcast(sample(labels, label, rows, key).withColumnRenamed(key, "k"))
    own = Aside(docs)
    d = own.df.select(own(key).alias("k"), text_or_empty(own(text)).alias("t")).join(chosen, "k").select("k", "y", "t")

    def out(b: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"k": b["k"], "y": b["y"], "x": list(x)})

    made = _with_statistics(d, f"k {d.schema['k'].dataType.simpleString()}, y int, x array<double>", out)
    got = made.groupBy("k").agg(F.min(F.struct("y", "x")).alias("s")).select("s.*").toPandas()
    x = np.stack(got["x"]) if len(got) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort((*x.T, got["y"]))  # the order of arrival must not change the sums
    return train(x[order], got["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1). Null and empty texts have the statistics zero, and a score like any other.

    A column named score, in upper or lower case, is replaced; rows with one key each get the score of their own text.
    """
    own = Aside(docs)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(STATISTICS)))
        return pd.Series(model.score(x))

    return own.df.select(*own.back(without=("score",)), of(text_or_empty(own(text))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


#: Trained trees are beyond SQL; the tests look at held-out accuracy and at the traversal by brute force.
SQL = None
