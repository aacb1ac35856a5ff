"""Where a user's models plug in: embedding and generation over Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.sources.written import Scratch, file_system, publish, written


#: Words whose places a HashEmbedder remembers at a time, so that a task's memory doesn't grow with its distinct words.
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class HashEmbedder:
    """Feature hashing: a word's bucket is its md5's first 8 hex digits by the dimension, its sign the ninth digit's parity."""

    dimension: int = P.DIMENSION

    def load(self) -> Callable[[list[str]], np.ndarray]:
        dimension = self.dimension

        class Places(dict):
            """Twice the bucket of a word, and one more if its sign is minus."""

            def __missing__(self, word: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                h = hashlib.md5(word.encode()).hexdigest()
                self[word] = at = int(h[:8], 16) % dimension * 2 + int(h[8], 16) % 2
                return at

        places = Places()

        def place(words: list[str]) -> np.ndarray:
            return np.fromiter(map(places.__getitem__, words), np.int64, len(words))

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for row, t in zip(out, texts, strict=True):
                n = np.bincount(place(t.lower().split()), minlength=2 * dimension)
                row[:] = n[::2] - n[1::2]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return run


@dataclass(frozen=True)
class Missing:
    """In place of a model that must not be needed."""

    def load(self):
        raise RuntimeError("a model is needed")


def embed_column(df: DataFrame, text_col: str, embedder=None, out: str = "embedding", batch_size: int = P.EMBEDDING_BATCH) -> DataFrame:
    """``df`` with ``out`` (array<float>, L2-normalised): the model is loaded once per task, and not at all for no rows."""
    embedder = embedder or HashEmbedder()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = None
        for texts in batches:
            model = model or embedder.load()
            own = [t or "" for t in texts.to_pylist()]
            vectors = [np.asarray(v, np.float32) for at in range(0, len(own), batch_size) for v in model(own[at : at + batch_size])]
            ends = np.cumsum([0, *map(len, vectors)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.float32), *vectors])))

    # else what is asked of the vectors (explode asks for their size) is moved below a shuffle, and the model called for that too
    return df.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def embed_stored(df: DataFrame, text_col: str, store: str, embedder=None, out: str = "embedding", scratch: Scratch | None = None, batch_size: int = P.EMBEDDING_BATCH) -> DataFrame:
    """``df`` with ``out``, like embed_column, from a store of vectors by the texts' content: each text is embedded once over all runs.

    The store is a folder of (hash, vector), one per embedder. Distinct texts by hash, less those that are stored, go to the
    model, spread evenly; their vectors are published as one more part of the store, and then all are joined. Only hashes
    meet the whole store, and the model is not loaded if there is nothing new. Two runs at a time may store a text twice; its vector
    is taken once. A null text is the empty one.
    """
    spark = df.sparkSession
    rows = written(df.withColumn("_hash", content_hash(F.col(text_col))), scratch)
    wanted = rows.select("_hash").distinct()
    texts = rows.groupBy("_hash").agg(F.first(F.coalesce(text_col, F.lit(""))).alias("_text"))
    files, path = file_system(spark, f"{store}/parts")
    kept = lambda: spark.read.schema("_hash string, _vector array<float>").parquet(f"{store}/parts/*")
    fresh = texts.join(kept().select("_hash"), "_hash", "left_anti") if files.exists(path) else texts
    fresh = written(fresh, scratch)
    if not fresh.isEmpty():
        new = embed_column(fresh.repartition("_hash"), "_text", embedder, "_vector", batch_size).select("_hash", "_vector")
        publish(new, store, "parts", uuid.uuid4().hex)
    if not files.exists(path):  # no rows at all, ever
        return rows.drop("_hash").withColumn(out, F.lit(None).cast("array<float>"))
    vectors = kept().join(wanted, "_hash", "left_semi").groupBy("_hash").agg(F.first("_vector").alias(out))
    return rows.join(vectors, "_hash").drop("_hash")


@dataclass(frozen=True)
class EchoGenerator:
    """Answers with the last message's text, cut to so many characters."""

    chars: int = 200

    def load(self) -> Callable[[list[list[dict]]], list[str]]:
        return lambda batch: [m[-1]["content"][: self.chars] if len(m) else "" for m in batch]


@dataclass(frozen=True)
class FirstQuestionGenerator:
    """Answers with the first sentence of the last message's text that ends in a question mark, else NONE."""

    def load(self) -> Callable[[list[list[dict]]], list[str]]:
        import re

        def one(m) -> str:
            text = m[-1]["content"].split("\n\n", 1)[-1] if len(m) else ""
            return next((s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip().endswith("?")), "NONE")

        return lambda batch: [one(m) for m in batch]


@dataclass(frozen=True)
class FixedGenerator:
    """Answers with the same text always."""

    reply: str

    def load(self) -> Callable[[list[list[dict]]], list[str]]:
        return lambda batch: [self.reply] * len(batch)


def padded_batches(lengths: list[int], most: int, budget: int = P.BATCH_CHARS, call: int = P.CALL_CHARS) -> list[list[int]]:
    """Places of rows in batches, longest first, that cost a model least: a batch costs ``call`` and its longest row for each row.

    A batch has ``most`` rows at most, and its padded size is within ``budget`` unless it has one row. The best cuts in the order of
    lengths are found by dynamic programming, in len(lengths) * most steps.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    longest = np.array([lengths[i] for i in order], float)
    best, came = np.zeros(len(order) + 1), np.zeros(len(order) + 1, int)
    for i in range(1, len(order) + 1):
        j = np.arange(max(0, i - most), i)
        padded = (i - j) * longest[j]
        cost = np.where((padded <= budget) | (i - j == 1), best[j] + call + padded, np.inf)
        came[i] = j[int(cost.argmin())]
        best[i] = cost.min()
    out, i = [], len(order)
    while i:
        out.append(order[came[i] : i])
        i = int(came[i])
    return out[::-1]


def is_out_of_memory(e: BaseException) -> bool:
    """Whether a smaller batch may help: MemoryError, and what model libraries raise in its place."""
    return isinstance(e, MemoryError) or "out of memory" in str(e).lower() or "OutOfMemory" in type(e).__name__


class Calls:
    """A model's calls of one task: batches within a size that out of memory halves, for good; every row gets an output or an error of its own."""

    def __init__(self, model: Callable, most: int) -> None:
        self.model, self.most = model, most

    def _call(self, rows: list[tuple]) -> list[str]:
        got = list(self.model(*map(list, zip(*rows, strict=True))))
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} completions for {len(rows)} prompts")
        for x in got:
            if not isinstance(x, str):
                raise TypeError(f"a completion is no text but {type(x).__name__}")
        return got

    def __call__(self, rows: list[tuple]) -> list[tuple]:
        """(output, error) of each row. Batches that fail otherwise than by memory are asked for row by row."""
        done: list[tuple] = []
        while len(done) < len(rows):
            part = rows[len(done) : len(done) + self.most]
            try:
                done += [(x, None) for x in self._call(part)]
            except Exception as e:  # any failure of a user's model is a row's error
                if len(part) == 1:
                    done.append((None, f"{type(e).__name__}: {e}"))
                elif is_out_of_memory(e):
                    self.most = max(1, len(part) // 2)
                else:
                    for row in part:
                        done += self([row])
        return done


def dealt_by_length(prompts: DataFrame, messages_col: str, keys: list[str], splits: int | None = None) -> DataFrame:
    """``prompts`` dealt over splits of near equal characters, each of prompts of like length, so that batches are padded little.

    Lengths fall into classes of half powers of two; a class has splits by its share of all characters, and rows are spread
    over these by the hash of ``keys``. What reaches the driver is a row per class, 130 at most.
    """
    spark = prompts.sparkSession
    splits = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = F.aggregate(F.coalesce(messages_col, F.array().cast(prompts.schema[messages_col].dataType)), F.lit(1).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    kind = F.floor(F.log2(chars) * 2).cast("int")
    sums = {r["k"]: r["n"] for r in prompts.groupBy(kind.alias("k")).agg(F.sum(chars).alias("n")).collect()}
    if not sums:
        return prompts
    share = [max(1, round(splits * sums.get(k, 0) / sum(sums.values()))) if k in sums else 0 for k in range(max(sums) + 1)]
    first = np.cumsum([0, *share]).tolist()
    of = lambda numbers: F.get(F.array(*map(F.lit, numbers)), kind)
    split = of(first[:-1]) + F.pmod(F.xxhash64(*keys), of(share)).cast("int")
    return prompts.withColumn("_split", split).repartitionByRange(first[-1], "_split").drop("_split")


def generate_column(
    df: DataFrame, messages_col: str, generator=None, out: str = "output", batch_size: int = P.SUMMARY_BATCH, max_tokens: Column | None = None, budget: int = P.BATCH_CHARS
) -> DataFrame:
    """``df`` with ``out`` and ``error``: completions in batches of like lengths, by the cost model of padded_batches.

    Out of memory halves the batch for the rest of the task, down to one. A row whose completion fails, or is no text, has an
    error and no output; the job goes on. A batch for which a model returns another number of completions than there are
    prompts is asked for again row by row, so no row gets another's answer. A generator that has ``takes_limits`` is
    called with the rows' ``max_tokens`` too. Write the result before using it twice: a task that is tried again calls the model again.
    """
    generator = generator or EchoGenerator()
    limited = bool(getattr(generator, "takes_limits", False)) and max_tokens is not None

    @F.pandas_udf(f"{out} string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        calls = None
        for rows, limits in batches:
            calls = calls or Calls(generator.load(), batch_size)
            own = [list(m) if m is not None else [] for m in rows]
            asked = [(m, int(n)) if limited else (m,) for m, n in zip(own, limits, strict=True)]
            got: list = [None] * len(own)
            for part in padded_batches([sum(len(x["content"] or "") for x in m) for m in own], batch_size, budget):
                for i, r in zip(part, calls([asked[i] for i in part]), strict=True):
                    got[i] = r
            yield pd.DataFrame(got, columns=[out, "error"])

    run = run.asNondeterministic()  # else a filter on the output is moved below it, and the model called for the filter too
    limit = F.coalesce(max_tokens, F.lit(0)).cast("int") if limited else F.lit(0)
    return df.withColumn("_g", run(F.col(messages_col), limit)).withColumn(out, F.col(f"_g.{out}")).withColumn("error", F.col("_g.error")).drop("_g")
