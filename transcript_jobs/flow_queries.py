"""Queries of whole flows, streams and stored tables, with the same results in SQL; models are deterministic stand-ins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs import queries as Q
from transcript_jobs.jobs import flows
from transcript_jobs.operators import long_videos, models, questions, segments, summaries, vector_index
from transcript_jobs.queries import REGISTERED, register
from transcript_jobs.sources import bucketed, tables
from transcript_jobs.sources import testdata as D
from transcript_jobs.sources.written import FREES_SHUFFLES, file_system, settings, shared_dir
from transcript_jobs.streaming import arrivals

LINES = [f"line {i}" for i in range(1, 17)]
_CHUNKS = f"{Q._REC}, {Q._chunk_sql(P.CHUNK_WORDS)}"
_MINED = f"""{Q._REC}, {Q._OWN_CAP}, {Q._ANSWERED}, {Q._GREEDY}, mined AS (
  SELECT q.video_id, question, start, "end", segment_index FROM q JOIN last USING (video_id) WHERE list_contains(kept, i)
  QUALIFY row_number() OVER (PARTITION BY q.video_id ORDER BY {Q._SCORE} DESC, start, segment_index) <= {P.QUESTIONS}
)"""


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}"


@register("ingest", f"""{_CHUNKS} SELECT 'chunk' AS kind, video_id, chunk_id AS place, text FROM chunks UNION ALL SELECT 'segment', video_id, seg_idx, text FROM segments
UNION ALL SELECT 'text', video_id, 0, string_agg(text, ' ' ORDER BY seg_idx) FROM segments GROUP BY video_id""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.ingest(D.segments(spark, sf_dir))
    row = lambda name, place, text, kind: out[name].select(F.lit(kind).alias("kind"), "video_id", place.cast("int").alias("place"), F.col(text).alias("text"))
    return row("chunks", F.col("chunk_id"), "text", "chunk").union(row("segments", F.col("seg_idx"), "text", "segment")).union(row("full_text", F.lit(0), "full_text", "text"))


@register("mine_questions", f"{_MINED} SELECT * FROM mined")
def mine_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.mine_questions(Q._clean(spark, sf_dir))


@register(
    "answer_questions",
    f"""{Q._PAIRS}, {Q._BUDGET.format(m=P.CONTEXT_WORDS)}
SELECT a.question_id, CASE WHEN k.question_id IS NULL THEN '{P.NO_ANSWER.replace("'", "''")}' ELSE 'Found.' END AS answer, true AS success,
       (CASE WHEN k.question_id IS NULL THEN 0 ELSE 1 END)::INT AS n_sources, coalesce(k.chunk_id, 0)::INT AS chunk_id, coalesce(k.similarity, 0.0)::DOUBLE AS similarity, a.question_id % 40 = 0 AND a.question_id % 3 <> 0 AS rewritten
FROM asked a LEFT JOIN kept k ON k.question_id = a.question_id AND k.place = 1""",
)
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions stand with their vectors, which an embedder looks up; some are follow-ups, some sessions have a history."""
    q, chunks = D.asked(spark, sf_dir), D.vectors(spark, sf_dir)
    k = F.col("question_id")
    message = F.when(k % 40 == 0, "What about it then, in a few words?").otherwise("Which topics are covered by videos?")
    asked = q.select("question_id", F.concat(F.lit("s"), k.cast("string")).alias("session_id"), "video_id", message.alias("message"), "embedding")
    history = asked.filter(k % 3 != 0).select("session_id", F.lit(1).alias("place"), F.lit("user").alias("role"), F.lit("Tell me more.").alias("message"))
    out = flows.answer_questions(asked, history, chunks, models.FixedGenerator("Found. Sources: 1"), embedder=flows.KEEP_VECTORS)
    source = F.get("sources", F.lit(0))
    return out.select(
        "question_id", "answer", "success", F.size("sources").alias("n_sources"), F.coalesce(source["chunk_id"], F.lit(0)).alias("chunk_id"),
        F.coalesce(source["similarity"], F.lit(0.0)).alias("similarity"),
        (F.col("search_query") != F.col("message")).alias("rewritten"),
    )


@register(
    "summarize_videos",
    f"""{Q._SEG}, d AS (SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id, doc_id FROM documents), u AS (SELECT DISTINCT video_id FROM segments)
SELECT video_id, CASE WHEN video_id IN (SELECT video_id FROM u) THEN '{chr(10).join(LINES)}' END AS summary,
       CASE WHEN video_id NOT IN (SELECT video_id FROM u) THEN '{P.NOTHING_TO_SUMMARIZE}' END AS error FROM d""",
)
def summarize_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All videos, those without a segment with one blank chunk."""
    chunks = Q._chunks(spark, sf_dir).select("video_id", "chunk_id", "text")
    blank = D.videos(spark, sf_dir).select("video_id", F.lit(0).alias("chunk_id"), F.lit(" ").alias("text"))
    reply = json.dumps({"summary_lines": LINES, "main_topics": [], "key_points": [], "conclusions": []})
    out = flows.summarize_videos(chunks.unionByName(blank), models.FixedGenerator(reply))
    return out.select("video_id", F.col("summary.summary").alias("summary"), "error")


@register(
    "retry_prompts",
    f"""SELECT doc_id, 'Write.' AS system, text || chr(10) || chr(10) || 'Your last reply had only ' || len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))
       || ' summary_lines. Write at least {P.SUMMARY_LINES}, each with another fact.' AS last FROM documents""",
)
def retry_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the prompt and as the reply that was too short."""
    turns = summaries.messages(F.lit("Write."), F.col("text"))
    rows = D.documents(spark, sf_dir).select("doc_id", turns.alias("messages"), F.struct(F.col("text").alias("summary")).alias("summary"))
    return summaries.retry_prompts(rows).select("doc_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("last"))


@register("save_and_load", f"{Q._SEG} SELECT video_id, seg_idx, start, \"end\", text FROM segments")
def save_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned segments, saved in two goes and loaded again."""
    folder, clean = _folder(spark), Q._clean(spark, sf_dir)
    tables.save_table(clean.filter("seg_idx % 2 = 0"), folder, "segments", buckets=16, files=2)
    tables.save_table(clean.filter("seg_idx % 2 = 1"), folder, "segments")
    return tables.load_table(spark, folder, "segments")


def _arrive(spark: SparkSession, folder: str, lines: DataFrame, goes: int = 1) -> None:
    """``lines`` (of JSON, with the ``go`` they come in, where there are several) come as more files, and the stream goes on after each go."""
    lines = lines if "go" in lines.columns else lines.withColumn("go", F.lit(0))
    with settings(spark, FREES_SHUFFLES | {"spark.sql.maxConcurrentOutputFileWriters": str(goes)}):  # both files of a task are open, so rows are not sorted
        lines.write.partitionBy("go").text(f"{folder}/sent", compression="gzip")
    for go in range(goes):
        files, sent = file_system(spark, f"{folder}/sent/go={go}")
        if files.exists(sent):
            files.mkdirs(file_system(spark, f"{folder}/incoming")[1])
            files.rename(sent, file_system(spark, f"{folder}/incoming/{go}")[1])
        arrivals.stream_index(spark, f"{folder}/incoming/*", folder, f"{folder}/stream-index", buckets=8).awaitTermination()


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the tables after all transcripts arrived as files of JSON lines."""
    folder = _folder(spark)
    _arrive(spark, folder, D.whole_videos(spark, sf_dir).select(F.to_json(F.struct("video_id", "segments"))))
    return folder


_INDEXED = f"""{_CHUNKS}, n AS (SELECT video_id, count(*) AS chunks, sum(word_count)::BIGINT AS words FROM chunks GROUP BY video_id),
t AS (SELECT video_id, max("end") AS duration, string_agg(text, ' ' ORDER BY seg_idx) AS full_text FROM segments GROUP BY video_id)
SELECT v.video_id, CASE WHEN n.video_id IS NULL THEN 'failed' ELSE 'ready' END AS status, coalesce(chunks, 0) AS chunks, coalesce(words, 0) AS words, duration, full_text
FROM (SELECT DISTINCT video_id FROM raw_segments) v LEFT JOIN n USING (video_id) LEFT JOIN t USING (video_id)"""


def _index_of(spark: SparkSession, folder: str) -> DataFrame:
    n = tables.load_table(spark, folder, "chunks").groupBy("video_id").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
    v = tables.load_table(spark, folder, "videos").select("video_id", "status").join(n, "video_id", "left").fillna(0, ["chunks", "words"])
    return v.join(tables.load_table(spark, folder, "transcripts").select("video_id", "duration", "full_text"), "video_id", "left")


@register("stream_index", _INDEXED)
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index_of(spark, _indexed(spark, sf_dir))


@register("stream_videos_in_parts", _INDEXED)
def stream_videos_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video comes in two parts, in files of two batches: every other video's second part comes first."""
    folder, n = _folder(spark), F.size("segments")
    lines = D.whole_videos(spark, sf_dir).withColumn("half", F.floor(n / 2).cast("int"))
    own = F.when(F.col("part") == 0, F.slice("segments", 1, F.col("half"))).otherwise(F.slice("segments", F.col("half") + 1, n))
    lines = lines.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("segments", own)
    first = F.col("part") == F.substring("video_id", 4, 8).cast("int") % 2
    go = F.when(first, 0).otherwise(1).alias("go")
    _arrive(spark, folder, lines.select(F.to_json(F.struct("video_id", "part", F.lit(2).alias("parts"), "segments")).alias("value"), go), 2)
    return _index_of(spark, folder)


#: Every document as a line, two of five of them damaged in one way or another.
_TOLD = """SELECT CASE WHEN k IN (3, 5, 7, 9) THEN doc_id::VARCHAR WHEN k = 8 THEN '' ELSE 'vid' || lpad(doc_id::VARCHAR, 8, '0') END AS who, CASE k WHEN 3 THEN 'not JSON' WHEN 5 THEN 'not an object'
  WHEN 7 THEN 'no video_id' WHEN 8 THEN 'blank' WHEN 9 THEN 'bad part' ELSE '' END AS reason, CASE WHEN k IN (0, 1, 2, 4, 6) THEN text END AS text, 1::BIGINT AS lines
FROM (SELECT *, doc_id % 10 AS k FROM documents)"""
_TOLD = f"SELECT who, reason, text, sum(lines)::BIGINT AS lines FROM ({_TOLD}) GROUP BY ALL"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    body = F.struct(F.when(k != 7, D._video_id()).alias("video_id"), "doc_id", F.when(k == 9, 1).alias("part"), "text", F.array().cast("array<int>").alias("segments"))
    line = F.to_json(body)
    cut, listed = F.expr("left(line, length(line) - 1)"), F.concat(F.lit("["), "line", F.lit("]"))
    return D.documents(spark, sf_dir).withColumn("line", line).select(F.when(k == 3, cut).when(k == 5, listed).when(k == 8, F.lit("  ")).otherwise(F.col("line")).alias("value"))


def _by_line(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Lines by what they are of: a video with its text, or else the document that the damaged line tells."""
    of = F.regexp_extract("line", r'"doc_id":([0-9]+)', 1)
    rows = good.select(F.col("video_id").alias("who"), F.lit("").alias("reason"), "text").unionByName(bad.select(of.alias("who"), "reason", F.lit(None).cast("string").alias("text")))
    return rows.groupBy("who", "reason", "text").agg(F.count("*").alias("lines"))


@register("read_transcripts", _TOLD)
def read_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files: those that can be read are videos, all others are quarantined."""
    folder = _folder(spark)
    _damaged(spark, sf_dir).write.text(f"{folder}/lines")
    lines = tables.read_lines(spark, f"{folder}/lines")
    return _by_line(tables.transcripts_of(lines).withColumn("text", F.get_json_object("raw", "$.text")), tables.quarantined(lines))


@register("stream_quarantine", _TOLD.replace("THEN text END AS text", "THEN 'failed' END AS text"))
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as arrivals: the videos that came of them (all failed, as they have no segments), and the quarantine."""
    folder = _folder(spark)
    _arrive(spark, folder, _damaged(spark, sf_dir))
    bad = spark.read.schema(arrivals.QUARANTINE).parquet(f"{folder}/quarantine/*")
    return _by_line(tables.load_table(spark, folder, "videos").withColumn("text", F.col("status")), bad)


@register("stream_questions", f"{_MINED} SELECT * FROM mined")
def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _indexed(spark, sf_dir)
    arrivals.stream_questions(spark, folder, f"{folder}/stream-questions").awaitTermination()
    return tables.load_table(spark, folder, "questions")


@register(
    "save_summaries",
    f"""{Q._CHUNKED} SELECT video_id, coalesce(version, -1) = 3 AS cached_1, coalesce(version, -1) = 3 AS cached_2, true AS cached_3, 3 AS version,
       CASE WHEN version = 3 THEN text ELSE '{chr(10).join(LINES)}' END AS summary, false AS raw
FROM videos JOIN (SELECT 'vid' || lpad(doc_id::VARCHAR, 8, '0') AS video_id, text FROM documents) USING (video_id)
WHERE status = 'ready' AND video_id IN (SELECT video_id FROM has)""",
)
def save_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over stored videos: replies that can't be read are never stored, good ones are, and then no model is needed."""
    folder = _folder(spark)
    tables.save_table(D.videos(spark, sf_dir), folder, "videos", buckets=8)
    tables.save_table(Q._chunks(spark, sf_dir), folder, "chunks", buckets=8)
    reply = json.dumps({"summary_lines": LINES, "main_topics": [], "key_points": [], "conclusions": []})
    out = None
    for n, generator in enumerate((models.FixedGenerator("No JSON."), models.FixedGenerator(reply), models.FixedGenerator("Not asked.")), 1):
        run = flows.summarize_stored(spark, folder, generator).select("video_id", F.col("cached").alias(f"cached_{n}"))
        out = run if out is None else out.join(run, "video_id")
    stored = tables.load_table(spark, folder, "videos")
    return out.join(stored, "video_id").select(
        "video_id", "cached_1", "cached_2", "cached_3", "summary.version", "summary.summary", F.col("summary.raw_output").isNotNull().alias("raw")
    )


@register("embed_stored", REGISTERED["index_videos"][1])
def embed_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from a store: every other video first, then all, and again all, for which no model is needed."""
    folder, raw = _folder(spark), D.segments(spark, sf_dir)
    flows.index_videos(raw.filter("doc_id % 2 = 0"), store=folder).write.format("noop").mode("overwrite").save()
    flows.index_videos(raw, store=folder).write.format("noop").mode("overwrite").save()
    e = flows.index_videos(raw, models.Missing(), store=folder).select("video_id", "chunk_id", F.posexplode("embedding").alias("place", "x"))
    return e.filter("x <> 0").select("video_id", "chunk_id", "place", F.round(F.col("x").cast("double"), 3).alias("weight"))


@register(
    "chat_turn",
    f"""{Q._PAIRS}, {Q._BUDGET.format(m=P.CONTEXT_WORDS)}, r AS (
  SELECT *, CASE WHEN question_id % 7 = 3 THEN '{P.EMPTY_QUESTION}' WHEN video_id = 'label000004' THEN '{P.NOT_INDEXED.replace("'", "''")}' END AS error FROM asked
)
SELECT r.question_id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN CASE WHEN k.question_id IS NULL THEN '{P.NO_ANSWER.replace("'", "''")}' ELSE 'Found.' END END AS answer,
       CASE WHEN error IS NULL THEN CASE WHEN r.question_id % 20 = 0 THEN 's' ELSE 'new' END || r.question_id END AS session_id, CASE WHEN error IS NULL THEN 2 ELSE 0 END::BIGINT AS messages,
       error IS NULL AND r.question_id % 20 <> 0 AS new_session
FROM r LEFT JOIN kept k ON k.question_id = r.question_id AND k.place = 1""",
)
def chat_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From requests to stored messages: some are blank, one video isn't indexed, every other session is of another video."""
    q, chunks, k = D.asked(spark, sf_dir), D.vectors(spark, sf_dir), F.col("question_id")
    name = F.concat(F.lit("s"), k.cast("string"))
    asked = q.select("question_id", name.alias("session_id"), "video_id", F.when(k % 7 == 3, "  ").otherwise("Which topics are covered by videos?").alias("message"), "embedding")
    videos = chunks.select("video_id", F.when(F.col("video_id") == "label000004", P.PROCESSING).otherwise(P.READY).alias("status")).distinct()
    sessions = q.select(name.alias("session_id"), F.when(k % 20 == 0, F.col("video_id")).otherwise("another").alias("video_id"))
    old = q.select(name.alias("session_id"), F.lit(1).alias("msg_id"), F.lit("user").alias("role"), F.lit("Tell me more.").alias("message"), F.timestamp_seconds(k).alias("created_at"))
    out = flows.chat_turn(asked, videos, sessions, old, chunks, models.FixedGenerator("Found. Sources: 1"), flows.KEEP_VECTORS, F.concat(F.lit("new"), k.cast("string")))
    m = out["messages"].groupBy("session_id").agg(F.count("*").alias("messages"))
    new = out["sessions"].select("session_id", F.lit(True).alias("new_session"))
    done = out["answers"].withColumn("session_id", F.when(F.col("success"), F.col("session_id")))
    return done.join(m, "session_id", "left").join(new, "session_id", "left").select(
        "question_id", "success", "error", "answer", "session_id", F.coalesce("messages", F.lit(0)).cast("long").alias("messages"), F.coalesce("new_session", F.lit(False)).alias("new_session")
    )


# --- videos of any length: the rows of the operators that see a video in one task --------------------------------


@register("clean_segments_ranged", REGISTERED["clean_segments"][1])
def clean_segments_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_videos.clean_segments(D.segments(spark, sf_dir))


def _stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    tables.save_table(Q._clean(spark, sf_dir), folder, "segments", buckets=8)
    return tables.load_table(spark, folder, "segments")


@register("question_windows_ranged", REGISTERED["question_windows"][1])
def question_windows_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 64 segments, so that many windows lie on a border."""
    return long_videos.question_windows(_stored_segments(spark, sf_dir), block=64)


@register("chunk_segments_ranged", REGISTERED["chunk_segments_500"][1])
def chunk_segments_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 64 segments, so that many chunks lie on a border."""
    return long_videos.chunk_segments(_stored_segments(spark, sf_dir), block=64)


@register("retrieve_chunks_indexed", REGISTERED["retrieve_chunks"][1])
def retrieve_chunks_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are indexed, stored and loaded, and questions look at some of their cells."""
    folder, chunks = _folder(spark), D.vectors(spark, sf_dir)
    vector_index.save_vectors(chunks, folder)
    vectors, cells = (tables.load_table(spark, folder, t) for t in ("vectors", "cells"))
    return vector_index.retrieve_indexed(D.asked(spark, sf_dir), vectors, cells, chunks).select(*Q._RETRIEVED)


# --- tables laid out by Spark's buckets ---------------------------------------------------------------------------


@register("bucketed_windows", REGISTERED["question_windows"][1])
def bucketed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw segments in a bucketed table, some videos of which were wrong and are replaced: cleaned and put in windows without an exchange."""
    folder, raw = _folder(spark), D.segments(spark, sf_dir)
    wrong = raw.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("why? "), "text")).otherwise(F.col("text")))
    bucketed.save(wrong, folder, "raw_segments", buckets=8, groups=4)
    again = raw.filter("doc_id % 3 = 0")
    bucketed.replace(again, folder, "raw_segments", again)
    return questions.question_windows(segments.clean_segments(bucketed.load(spark, folder, "raw_segments")))
