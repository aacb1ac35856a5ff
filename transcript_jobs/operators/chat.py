"""Requests, sessions, history, prompts, stored messages and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.citations import build_context
from transcript_jobs.functions.text import strip
from transcript_jobs.operators.questions import messages as prompt

REWRITE_SYSTEM = (
    "Rewrite the latest question so that it can be understood alone, for a search in a video transcript. Use the conversation only "
    "to put names in the place of words like 'it' or 'the second one'; add no facts. If nothing must be replaced, repeat the question "
    "as it is. Output the question and nothing else."
)
ANSWER_SYSTEM = (
    "Answer a question about one video from the VIDEO CONTEXT alone, in about 100 words at most, without timestamps or outside "
    "knowledge. If the context does not tell, reply with exactly this sentence: \"" + P.NO_ANSWER + "\" If there is a line "
    "'Interpreted as', answer that. End with one line that lists the chunks you used, in the form: Sources: 1, 3"
)


def valid_requests(requests: DataFrame, indexed: DataFrame) -> DataFrame:
    """Requests with video_id and message cut to their limits, and ``error`` (NULL if the request is good)."""
    r = requests.withColumn("video_id", F.substring(strip(F.coalesce("video_id", F.lit(""))), 1, P.VIDEO_ID_CHARS))
    r = r.withColumn("message", F.substring(strip(F.coalesce("message", F.lit(""))), 1, P.QUESTION_CHARS))
    known = indexed.select("video_id").distinct().withColumn("_known", F.lit(True))
    error = F.when((F.col("video_id") == "") | (F.col("message") == ""), P.EMPTY_QUESTION).when(F.col("_known").isNull(), P.NOT_INDEXED)
    return r.join(known, "video_id", "left").withColumn("error", error).drop("_known")


def resolve_sessions(requests: DataFrame, sessions: DataFrame, fresh=None) -> DataFrame:
    """Requests with a session of the same video: the given one if it is, else a new id (``fresh``: a column; by default random)."""
    s = sessions.select(F.col("session_id").alias("session_id"), "video_id", F.lit(True).alias("_own"))
    new = F.uuid() if fresh is None else fresh
    out = requests.join(s, ["session_id", "video_id"], "left")
    return out.withColumn("session_id", F.when(F.col("_own"), F.col("session_id")).otherwise(new)).drop("_own")


def recent_history(messages: DataFrame, n: int = P.HISTORY, sessions: DataFrame | None = None) -> DataFrame:
    """The last n messages of each session, with ``place`` from 1, oldest first; only of ``sessions`` if they are given."""
    m = messages if sessions is None else messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    by = Window.partitionBy("session_id")
    last = m.withColumn("_n", F.row_number().over(by.orderBy(F.desc("created_at"), F.desc("msg_id")))).filter(F.col("_n") <= n)
    return last.withColumn("place", F.max("_n").over(by) - F.col("_n") + 1).drop("_n")


def rewrite_prompts(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests with ``history_size`` and ``messages`` that ask for a standalone question."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    line = F.struct("place", F.concat(who, F.substring("message", 1, 300)).alias("line"))
    h = history.groupBy("session_id").agg(F.array_sort(F.collect_list(line)).alias("_h"))
    text = F.array_join(F.transform("_h", lambda x: x["line"]), "\n")
    user = F.concat(F.lit("Conversation:\n"), F.coalesce(text, F.lit("")), F.lit("\nLatest question: "), "message", F.lit("\nStandalone question:"))
    return (
        requests.join(h, "session_id", "left")
        .withColumn("history_size", F.coalesce(F.size("_h"), F.lit(0)))
        .withColumn("messages", prompt(F.lit(REWRITE_SYSTEM), user))
        .drop("_h")
    )


def answer_prompts(rows: DataFrame) -> DataFrame:
    """Rows (message, search_query, chunks) with ``messages``: the question, its reading if rewritten, and the context."""
    read = F.when(F.col("search_query") != F.col("message"), F.concat(F.lit("\n(Interpreted as: "), "search_query", F.lit(")"))).otherwise("")
    user = F.concat(F.lit("USER QUESTION\n"), "message", read, F.lit("\n\nVIDEO CONTEXT\n\n"), build_context(F.col("chunks")))
    return rows.withColumn("messages", prompt(F.lit(ANSWER_SYSTEM), user))


def append_messages(results: DataFrame) -> DataFrame:
    """Two messages (user, assistant with sources) per answered row; failed rows give none."""
    none = F.slice("sources", 1, 0)
    turn = lambda place, role, c, s: F.struct(F.lit(place).alias("place"), F.lit(role).alias("role"), F.col(c).alias("message"), s.alias("sources"))
    both = F.array(turn(0, "user", "message", none), turn(1, "assistant", "answer", F.col("sources")))
    return results.filter("success").select("session_id", F.explode(both).alias("m")).select("session_id", "m.*")


def audit_sources(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, msg_id, chunk_id, problem) of stored sources that are no chunk of the answer's video, or have other times."""
    s = answers.select("session_id", "msg_id", "video_id", F.explode("sources").alias("s")).select(
        "session_id", "msg_id", "video_id", F.col("s.chunk_id").alias("chunk_id"), F.col("s.start").alias("_start"), F.col("s.end").alias("_end")
    )
    c = chunks.select("video_id", "chunk_id", "start", "end")
    problem = F.when(F.col("start").isNull(), "unknown chunk").when((F.col("start") != F.col("_start")) | (F.col("end") != F.col("_end")), "other times")
    return s.join(c, ["video_id", "chunk_id"], "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("session_id", "msg_id", "chunk_id", "problem")
