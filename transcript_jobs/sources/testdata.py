"""Transcript tables derived from the given text tables, by one rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VECTOR_WORDS = 64


def _video_id(doc_id: str = "doc_id"):
    return F.concat(F.lit("vid"), F.lpad(F.col(doc_id).cast("string"), 8, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _words(line):
    return F.size(F.array_remove(F.split(line, " "), ""))


def _segment(doc_id, pos, line, n, before) -> list:
    """start, end and text of a line of ``n`` words, with so many ``before`` it."""
    start = before * 0.5 + F.floor(pos / 5) * 3.0
    blank = (pos % 13 == 12) | (doc_id % 50 == 49)
    end = F.when(pos % 11 == 10, start - 1).otherwise(start + n * 0.5)
    text = F.when(blank, F.lit("   ")).when(pos % 7 == 3, F.concat(line, F.lit("?"))).otherwise(line)
    return [start.alias("start"), end.alias("end"), text.alias("text")]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw segments (video_id, doc_id, pos, start, end, text): one per line, with a gap at every fifth, and some dirty."""
    lines = documents(spark, sf_dir).select(_video_id().alias("video_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = _words(F.col("line"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("n", n).withColumn("before", before)
    return rows.select("video_id", "doc_id", "pos", *_segment(*map(F.col, ("doc_id", "pos", "line", "n", "before"))))


def whole_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, segments): the raw segments of each video in order, made of its document's row, without a shuffle."""
    sums = lambda lines: F.aggregate(lines, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.get(s, F.size(s) - 1) + _words(x))))
    # a list of one element, so that the sums are made once for all lines
    both = F.transform(F.array(F.split("text", "\n")), lambda lines: F.struct(lines.alias("lines"), sums(lines).alias("sums")))
    one = lambda line, i, before, after: F.struct(*_segment(F.col("doc_id"), i, line, after - before, before))
    own = lambda b: F.transform(b["lines"], lambda line, i: one(line, i, F.get(b["sums"], i), F.get(b["sums"], i + 1)))
    return documents(spark, sf_dir).filter("text IS NOT NULL").select(_video_id().alias("video_id"), F.get(F.transform(both, own), F.lit(0)).alias("segments"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, language, has_segments): every 97th has no list of segments at all."""
    return documents(spark, sf_dir).select(_video_id().alias("video_id"), F.col("lang").alias("language"), (F.col("doc_id") % 97 != 96).alias("has_segments"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with addresses in several forms, statuses and summary versions by doc_id."""
    v, k = _video_id(), F.col("doc_id")
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&t=10s")))
        .when(k % 5 == 1, F.concat(F.lit("  http://youtu.be/"), v, F.lit("?si=x ")))
        .when(k % 5 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v, F.lit("/")))
        .when(k % 5 == 3, F.concat(F.lit("https://example.com/watch?v="), v))
        .otherwise(F.concat(F.lit("https://music.youtube.com/watch?list=a&v="), v))
    )
    version = F.when(k % 3 == 0, 3).when(k % 3 == 1, 2)
    summary = F.when(
        version.isNotNull(),
        F.struct(
            F.col("text").alias("summary"), *[F.array().cast("array<string>").alias(c) for c in ("main_topics", "key_points", "conclusions")],
            F.lit(None).cast("string").alias("raw_output"), version.cast("int").alias("version"),
        ),
    )
    status = F.element_at(F.array(*map(F.lit, ("ready", "ready", "processing", "failed"))), (k % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select(
        v.alias("video_id"), "doc_id", url.alias("url"), F.col("text").alias("title"), F.col("source").alias("channel"),
        F.lit("").alias("duration"), F.lit("").alias("thumbnail"), status.alias("status"), summary.alias("summary"),
        F.timestamp_seconds(k).alias("created_at"), F.timestamp_seconds(k).alias("updated_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors (video_id, chunk_id, start, end, text, vec_id, embedding): a video per label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    return (
        e.withColumn("chunk_id", rank)
        .join(d, "vec_id", "left")
        .select(
            F.concat(F.lit("label"), F.lpad(F.col("label").cast("string"), 6, "0")).alias("video_id"),
            "chunk_id",
            (F.col("chunk_id") * 60.0).alias("start"),
            (F.col("chunk_id") * 60.0 + 55.0).alias("end"),
            F.coalesce("text", F.lit("")).alias("text"),
            "vec_id",
            "embedding",
        )
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with vectors (question_id, video_id, embedding): every tenth vector, half of them asked of another video."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 10 = 0")
    label = F.when(F.col("vec_id") % 20 == 0, F.col("label")).otherwise((F.col("label") + 1) % 10)
    return e.select(F.col("vec_id").alias("question_id"), F.concat(F.lit("label"), F.lpad(label.cast("string"), 6, "0")).alias("video_id"), "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, msg_id, role, message, created_at) of users and assistants; two turns share a second."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role IN ('user', 'assistant')")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("msg_id"),
        "role",
        F.col("text").alias("message"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("turn") / 2)).alias("created_at"),
    )


# The same tables in SQL, to stand in a WITH clause.
SEGMENTS = r"""
lines AS (
  SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
), counted AS (
  SELECT *, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS n FROM lines
), timed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 0.5
            + (pos // 5) * 3.0 AS start
  FROM counted
), raw_segments AS (
  SELECT video_id, doc_id, pos, start::DOUBLE AS start, (CASE WHEN pos % 11 = 10 THEN start - 1 ELSE start + n * 0.5 END)::DOUBLE AS "end",
         CASE WHEN pos % 13 = 12 OR doc_id % 50 = 49 THEN '   ' WHEN pos % 7 = 3 THEN line || '?' ELSE line END AS text
  FROM timed
), segments AS (
  SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1)::INT AS seg_idx, start, "end", text
  FROM (SELECT video_id, pos, start, "end", trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM raw_segments WHERE start >= 0 AND "end" >= start)
  WHERE text <> ''
)"""
VIDEOS = """
videos AS (
  SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id, doc_id, ['ready', 'ready', 'processing', 'failed'][doc_id % 4 + 1] AS status,
         CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS version, text AS title, source AS channel
  FROM documents
)"""
VECTORS = """
vectors AS (
  SELECT 'label' || lpad(label::VARCHAR, 6, '0') AS video_id, e.chunk_id, e.chunk_id * 60.0::DOUBLE AS start, e.chunk_id * 60.0::DOUBLE + 55 AS "end",
         coalesce(d.text, '') AS text, vec_id, embedding
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS chunk_id FROM embeddings) e LEFT JOIN documents d ON d.doc_id = e.vec_id
), asked AS (
  SELECT vec_id AS question_id, 'label' || lpad((CASE WHEN vec_id % 20 = 0 THEN label ELSE (label + 1) % 10 END)::VARCHAR, 6, '0') AS video_id, embedding
  FROM embeddings WHERE vec_id % 10 = 0
)"""
MESSAGES = """
messages AS (
  SELECT conv_id::VARCHAR AS session_id, turn AS msg_id, role, text AS message, 1700000000 + turn // 2 AS created_s
  FROM conversations WHERE role IN ('user', 'assistant')
)"""
