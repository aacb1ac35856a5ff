"""Toxicity: a window's vector is the mean of its words', a word's the mean of its character n-grams'; a softmax reads it.

A text is scored in all its windows of WINDOW words (a shorter one is filled up with zeros), and its highest
window is its score: a few words do not vanish in the mean of a long text. Vectors and softmax are trained jointly
in numpy on a bounded sample, by one task. As all is linear up to the softmax, each n-gram's share of the score is
one number, so a task needs one array, and keeps the words it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, table, text_or_empty
from transcript_jobs.llm.labelled import held_out, sample

#: Labelled rows that the model is trained on, at most, and bytes of the longest of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 1 << 15
ACCEPT = 0.7
NGRAMS, BUCKETS, WIDTH, WINDOW = (3, 4, 5), 1 << 16, 4, 8
#: An n-gram counts if it is in so many documents of the sample: else vectors of rare words learn documents by heart.
LEAST_DOCUMENTS = 4
#: Rounds of training: first on all windows, then on the highest of each document and as many others.
#: Windows a step, at most; fewer for a small sample, so that it gets STEPS steps.
ROUNDS, BATCH, STEPS, RATE = 8, 512, 400, 0.2
KEPT_WORDS = 300_000
#: Texts whose words are held at once.
TEXTS_AT_ONCE = 256


def tokens(text: str) -> list[str]:
    return text.lower().split()


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of ``<word>`` by code points, and of each whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # code points up to the word's end
    out_w, out_b = [], []
    mix = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h[: len(code) - n + 1] = (h[: len(code) - n + 1] ^ code[n - 1 :]) * mix
        h ^= h >> np.uint64(29)
        if n in NGRAMS:
            ok = left >= n
            out_w.append(word[ok])
            out_b.append(((h[ok] + np.uint64(n)) * mix >> np.uint64(40)).astype(np.int64) % BUCKETS)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(code), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    whole = np.add.reduceat((code + np.uint64(7)) * (place * np.uint64(2) + np.uint64(1)) * mix, starts)
    out_w.append(np.arange(len(words)))
    out_b.append(((whole ^ (whole >> np.uint64(31))) * mix >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(out_w), np.concatenate(out_b)


class Model:
    """Each n-gram's share of the logit, and the bias."""

    def __init__(self, share: np.ndarray, bias: float) -> None:
        self.share, self.bias, self.kept = share, bias, {}

    def __getstate__(self) -> dict:
        return {"share": self.share, "bias": self.bias, "kept": {}}

    def score(self, texts: list[str]) -> np.ndarray:
        """The likelihood of label 1 of each whole text; of a text without words, that of the bias alone."""
        parts = [self._score(texts[at : at + TEXTS_AT_ONCE]) for at in range(0, len(texts), TEXTS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score(self, texts: list[str]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = list({w for ws in split for w in ws if w not in self.kept})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            word, bucket = word_ngrams(part)
            n = np.bincount(word, minlength=len(part))
            self.kept.update(zip(part, (np.bincount(word, self.share[bucket], len(part)) / n).tolist(), strict=True))
        get = self.kept.__getitem__
        z = np.array([highest(np.fromiter(map(get, ws), float, len(ws)))[0] for ws in split]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def highest(shares: np.ndarray) -> tuple[float, int]:
    """The largest mean over a window of WINDOW words, and where that begins; 0 for no words."""
    if len(shares) <= WINDOW:
        return float(shares.sum()) / WINDOW, 0
    c = np.concatenate([[0.0], np.cumsum(shares)])
    sums = c[WINDOW:] - c[:-WINDOW]
    at = int(np.argmax(sums))
    return float(sums[at]) / WINDOW, at


def train(texts: list[str], labels: np.ndarray, seed: int = 3) -> Model:
    """Vectors and softmax by Adam on batches of documents. One class or no rows: the prior alone."""
    p = np.clip((labels.sum() + 0.5) / (len(labels) + 1.0), 1e-3, 1 - 1e-3)
    bias = np.array([0.0, np.log(p / (1 - p))])
    if len(labels) < 2 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(bias[1]))
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in tokens(t)), np.int32) for t in texts]
    docs, labels = [d for d in docs if len(d)], labels[[i for i, d in enumerate(docs) if len(d)]]
    names, parts, sizes_of = list(ids), [], []
    ids.clear()
    for at in range(0, len(names), 20_000):  # in parts, as the driver has little room
        gw, gb = word_ngrams(names[at : at + 20_000])
        parts.append(gb[np.argsort(gw, kind="stable")].astype(np.int32))
        sizes_of.append(np.bincount(gw))
    del names
    gb, n_grams = np.concatenate(parts), np.concatenate(sizes_of)
    del parts
    first = np.cumsum(n_grams) - n_grams

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = n_grams[words]
        return gb[np.repeat(first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        seen[np.unique(grams_of(np.unique(d))[0])] += 1
    counts = (seen >= LEAST_DOCUMENTS).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    vec = (rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH)) / WIDTH).astype(np.float32) * counts
    soft = rng.uniform(-1, 1, (WIDTH, 1)) * np.array([[-1.0, 1.0]]) * WINDOW / 4
    state = [np.zeros_like(x) for x in (vec, vec, soft, soft, bias, bias)]
    sizes = np.array([len(d) for d in docs])
    n_windows = -(-np.maximum(1, sizes - WINDOW // 2) // WINDOW)
    # (document, place) of all windows side by side
    every = np.stack([np.repeat(np.arange(len(docs)), n_windows), (np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * WINDOW], axis=1)
    total, step = len(every) + (ROUNDS - 1) * (2 * len(docs) - int(labels.sum())), 0
    batch = max(16, min(BATCH, total // STEPS))

    def shares() -> np.ndarray:
        line = vec @ (soft[:, 1] - soft[:, 0])
        return np.add.reduceat(line[gb], first) / n_grams

    for turn in range(ROUNDS):
        windows = every
        if turn:
            own = shares()
            top = [(i, highest(own[d])[1]) for i, d in enumerate(docs)]
            others = [(i, int(rng.integers(0, max(1, len(d) - WINDOW + 1)))) for i, d in enumerate(docs) if not labels[i]]
            windows = np.array(top + others, np.int64)
        mixed = rng.permutation(len(windows))
        for at in range(0, len(mixed), batch):
            part = windows[mixed[at : at + batch]]
            words = [docs[i][x : x + WINDOW] for i, x in part.tolist()]
            edges = np.cumsum([0, *map(len, words)])
            uniq, word = np.unique(np.concatenate(words), return_inverse=True)
            grams, sizes = grams_of(uniq)
            wv = np.add.reduceat(vec[grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            dv = np.add.reduceat(wv[word], edges[:-1], axis=0) / WINDOW
            z = dv @ soft + bias
            prob = np.exp(z - z.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(part)), labels[part[:, 0]]] -= 1
            prob /= len(part)
            g_doc = np.repeat(prob @ soft.T / WINDOW, np.diff(edges), axis=0)
            g_word = np.stack([np.bincount(word, g_doc[:, k], len(uniq)) for k in range(WIDTH)], axis=1) / sizes[:, None]
            spread = np.repeat(g_word, sizes, axis=0)
            g_vec = np.stack([np.bincount(grams, spread[:, k], BUCKETS) for k in range(WIDTH)], axis=1) * counts
            step += 1
            rate = RATE * max(0.05, 1 - step * batch / total)
            for k, (x, g) in enumerate(((vec, g_vec), (soft, dv.T @ prob), (bias, prob.sum(axis=0)))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(x.dtype)
    return Model((vec @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """The model, trained on at most ``rows`` labelled documents, by one task: the driver gets the model alone.

    Longer texts than SAMPLE_BYTES are not learned from; of rows with one key, one is.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(x for b in batches for x in zip(b["t"].tolist(), b["y"].tolist(), strict=True))  # the same in every run
        model = train([t for t, _ in got], np.array([y for _, y in got], int))
        yield pd.DataFrame({"share": [model.share.tobytes()], "bias": [model.bias]})

    chosen = F.broadcast(sample(labels, label, rows, key).withColumnRenamed(key, "k"))
    a = Aside(docs)
    own = a.df.select(a(key).alias("k"), text_or_empty(a(text)).alias("t")).join(chosen, "k").filter(F.octet_length("t") <= SAMPLE_BYTES)
    own = own.groupBy("k", "y").agg(F.min("t").alias("t")).select("t", "y")
    made = own.repartition(1).mapInPandas(learn, "share binary, bias double").head()
    return Model(np.frombuffer(made["share"]), made["bias"]) if made else train([], np.zeros(0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) of each row's whole text; null counts as empty. A column named score, in upper or lower case, is replaced."""
    a = Aside(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()), dtype="float64")

    return a.df.select(*a.back(without=("score",)), of(text_or_empty(a(text))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


#: A trained model is beyond SQL; the tests look at held-out accuracy, misspellings and a brute-force score.
SQL = None
