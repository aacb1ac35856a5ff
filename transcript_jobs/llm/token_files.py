"""Token ids as ORC files: run-length encoded ids in stripes, row indexes and Bloom filters on the documents' keys."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, shared_dir, table, text_or_empty
from transcript_jobs.llm.packing import default_tokenizer, ids_of

END = 2
#: Bytes of text that a file holds, about.
FILE_BYTES = 128 << 20
STRIPE_BYTES, STRIDE_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01


def write_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END,
    file_bytes: int = FILE_BYTES, stripe_bytes: int = STRIPE_BYTES, stride_rows: int = STRIDE_ROWS,
) -> None:
    """Writes (doc_id, part, at, n_tokens, ids) to ORC files at ``path``, in ascending key order: over all parts, and within each.

    ``ids`` are a text's and the id ``end``; a null or empty text is ``end`` alone. ``part`` is the number of the file's key range,
    ``at`` the ids before the document in its part, so that a document's place in the whole stream needs a sum per part only.

    Texts are shuffled once, by key range; ties of a key are ordered by the hash of their texts and are spread over ranges
    too, so rows of one key may be many. Null keys come first. Repeated rows are all written; other columns are left aside;
    an empty table writes empty files with their schema. A lost task is encoded again from its shuffled texts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    own = Aside(docs)
    kind, t = own.df.schema[own.here(key)].dataType.simpleString(), text_or_empty(own(text))
    rows = own.df.select(own(key).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("s"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = rows.repartitionByRange(files, "doc_id", "h", "s").sortWithinPartitions("doc_id", "h", "s")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = ids_of(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            own = enc.batch(b.column(1).to_pylist())
            sizes = np.array([len(x) for x in own], np.int64)
            ends = np.cumsum(sizes)
            ids = np.concatenate([*own, np.array([], np.uint32)]).astype(np.int32)
            ids[ends - 1] = end
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(b), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), lists], ["doc_id", "part", "at", "n_tokens", "ids"]
            )
            at += int(sizes.sum())

    out = ordered.select("doc_id", "t").mapInArrow(encode, f"doc_id {kind}, part int, at long, n_tokens long, ids array<int>")
    writer = out.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride_rows).option("orc.create.index", "true")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_POSITIVES).option("orc.compress", "ZSTD").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids) of the files. Stripes are read in parallel.

    A filter on doc_id reaches the reader, which passes over stripes and row groups by their ranges of keys and Bloom filters;
    columns that aren't asked for aren't read.
    """
    return spark.read.orc(path)


def with_start(tokens: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before a document. Reads a number per document, and joins a row per file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row per file
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the ids' number and their crc32 as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_crc32(with_start(read_tokens(spark, path)))


#: Token ids are beyond SQL; the tests encode anew with the tokenizer, and read the files by other means too.
SQL = None
