"""The flows: ingest, index, mine questions, answer, summarize. Compositions of the operators.

A model's outputs are written before they are used, so each call is made once; each flow returns tables. What they
write goes to ``scratch``, which the caller ends when it has read the results; without one it stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions import citations as C
from transcript_jobs.functions import summary_json as J
from transcript_jobs.functions.text import looks_like_follow_up, strip
from transcript_jobs.operators import chat, chunking, index, long_videos, models, questions, retrieval, segments, summaries
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import Scratch, written


#: In place of an embedder: the requests have their vectors already, in ``embedding``.
KEEP_VECTORS = object()


def ingest(raw: DataFrame, max_words: int = P.CHUNK_WORDS) -> dict[str, DataFrame]:
    """segments, full_text, chunks and rejected of raw segments (video_id, pos, start, end, text)."""
    clean = segments.clean_segments(raw)
    return {
        "segments": clean,
        "full_text": segments.full_text(clean),
        "chunks": chunking.chunk_segments(clean, max_words),
        "rejected": segments.rejected_segments(raw),
    }


def embed_chunks(chunks: DataFrame, embedder=None, store: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Chunks with vectors, dealt out evenly by row before the model, so that a long video makes no slow task.

    ``store``: a folder where vectors are kept by the content of their texts, so that no text is embedded twice.
    """
    if store:
        return models.embed_stored(chunks, "text", store, embedder, scratch=scratch)
    return models.embed_column(chunks.repartition(F.xxhash64("video_id", "chunk_id")), "text", embedder)


def index_videos(raw: DataFrame, embedder=None, max_words: int = P.CHUNK_WORDS, store: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Chunks with vectors of raw segments; see embed_chunks."""
    return embed_chunks(chunking.chunk_segments(segments.clean_segments(raw), max_words), embedder, store, scratch)


def mine_questions(clean: DataFrame, generator=None, embedder=None, scratch: Scratch | None = None, block: int | None = None) -> DataFrame:
    """(video_id, question, start, end, segment_index): the questions asked in cleaned segments. The model is called once per window.

    ``block``: so many segments of a video in a task at a time (see long_videos).
    """
    windows = questions.cap_candidates(long_videos.question_windows(clean, block=block) if block else questions.question_windows(clean))
    windows = written(windows, scratch)
    # a prompt has its window's text once more, so it is neither shuffled nor written
    dealt = models.dealt_by_length(questions.question_prompts(windows), "messages", ["video_id", "segment_index"]).drop("messages")
    generator = generator or models.FirstQuestionGenerator()
    asked = models.generate_column(questions.question_prompts(dealt), "messages", generator, batch_size=P.VALIDATION_BATCH, max_tokens=F.lit(P.VALIDATION_TOKENS))
    asked = written(asked.drop("messages"), scratch)
    found = questions.accept_questions(asked).select("video_id", "question", "start", "end", "segment_index")
    return questions.rank_questions(questions.dedupe_questions(found, embedder=embedder))


def answer_questions(requests: DataFrame, history: DataFrame, chunks: DataFrame, generator=None, embedder=None, scratch: Scratch | None = None) -> DataFrame:
    """(question_id, session_id, video_id, message, search_query, answer, sources, success, error) per request.

    ``requests``: (question_id, session_id, video_id, message), checked; ``history``: recent messages; ``chunks`` with vectors.
    Only follow-ups with a history are rewritten, and only requests with a relevant chunk are answered by the
    model; each of these calls is made once. A failed rewrite leaves the message as it is, a failed answer has an error.
    """
    r = chat.rewrite_prompts(requests, history).withColumn("follows", looks_like_follow_up(F.col("message")))
    unclear = (F.col("history_size") > 0) & F.coalesce("follows", F.lit(False))
    again = written(models.generate_column(r.filter(unclear), "messages", generator, "rewritten", max_tokens=F.lit(P.REWRITE_TOKENS)), scratch).drop("error")
    r = again.unionByName(r.filter(~unclear).withColumn("rewritten", F.lit(None).cast("string"))).drop("messages")
    query = C.accept_rewrite(F.col("message"), F.col("rewritten"), F.col("history_size"), F.col("follows"))
    r = r.withColumn("search_query", query)
    r = written(r if embedder is KEEP_VECTORS else models.embed_column(r, "search_query", embedder), scratch)
    found = retrieval.fit_word_budget(retrieval.relevant_chunks(retrieval.retrieve_chunks_blocked(r, chunks)))
    rows = written(r.drop("embedding").join(found, ["question_id", "video_id"], "left"), scratch)
    known = F.col("chunks").isNotNull()
    asked = models.generate_column(chat.answer_prompts(rows.filter(known)), "messages", generator, max_tokens=F.lit(P.ANSWER_TOKENS))
    cite = C.extract_citations(strip(F.coalesce("output", F.lit(""))), F.size("chunks"))
    cited = asked.withColumn("c", cite).withColumn("s", C.build_sources(F.col("video_id"), F.col("chunks"), F.col("c.cited")))
    done = cited.withColumn("f", C.finalize_answer(F.col("c.answer"), F.col("s")))
    cols = ["question_id", "session_id", "video_id", "message", "search_query"]
    answered = done.select(*cols, "f.answer", "f.sources", "f.success", "error")
    kind = answered.schema["sources"].dataType.simpleString()
    none = rows.filter(~known).select(
        *cols, F.lit(P.NO_ANSWER).alias("answer"), F.array().cast(kind).alias("sources"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")
    )
    return written(answered.unionByName(none), scratch)


def chat_turn(requests: DataFrame, videos: DataFrame, sessions: DataFrame, messages: DataFrame, chunks: DataFrame, generator=None, embedder=None, fresh=None, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """From raw requests (question_id, session_id, video_id, message) to what is stored of them: answers, messages, sessions.

    ``answers`` has every request: those that aren't good have an error and no success. ``messages`` are the two new ones of each answered
    request, ``sessions`` those that did not exist. ``fresh``: a column with new session ids (by default random).
    """
    checked = chat.valid_requests(requests, index.indexed_videos(videos, chunks))
    bad = checked.filter("error IS NOT NULL")
    good = written(chat.resolve_sessions(checked.filter("error IS NULL").drop("error"), sessions, fresh), scratch)
    history = chat.recent_history(messages, sessions=good)
    done = answer_questions(good, history, chunks, generator, embedder, scratch)
    refused = bad.select("question_id", "session_id", "video_id", "message", F.lit(False).alias("success"), "error")
    return {
        "answers": done.unionByName(refused, allowMissingColumns=True),
        "messages": chat.append_messages(done),
        "sessions": good.select("session_id", "video_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti"),
    }


def summarize_videos(chunks: DataFrame, generator=None, scratch: Scratch | None = None) -> DataFrame:
    """(video_id, summary struct, error) of every video: the better of two attempts over the transcript or the summaries of its chunks.

    A video without a usable chunk, one of whose chunks the model failed for, or without any output, has an error and no summary.
    Each model call is made once, and ``chunks`` is read once. The prompt of a first attempt is kept for those alone that are tried again.
    """
    rows = written(summaries.planned_with_unusable(chunks), scratch)
    planned = rows.filter("usable").drop("usable")
    prompts = models.dealt_by_length(summaries.chunk_prompts(planned), "messages", ["video_id", "chunk_id"])
    mapped = written(models.generate_column(prompts, "messages", generator, max_tokens=F.col("max_tokens")).select("video_id", "chunk_id", "mode", F.col("output").alias("text"), "error"), scratch)
    failed = mapped.filter("error IS NOT NULL").select("video_id").distinct()
    sections = planned.filter("mode = 'direct'").select("video_id", "chunk_id", "mode", "text").unionByName(mapped.drop("error").join(failed, "video_id", "left_anti"))

    def attempt(p: DataFrame) -> DataFrame:
        out = models.generate_column(p, "messages", generator, max_tokens=F.lit(P.FINAL_TOKENS)).filter("output IS NOT NULL")
        out = out.withColumn("summary", J.final_summary(F.col("output")))
        return written(out.select("video_id", F.when(summaries.is_short(), F.col("messages")).alias("messages"), "summary"), scratch)

    first = attempt(summaries.final_prompts(summaries.combine_sections(sections)))
    second = attempt(summaries.retry_prompts(summaries.needs_retry(first)).select("video_id", "messages"))
    best = summaries.select_attempt(first, second)
    every = rows.groupBy("video_id").agg(F.max(F.col("usable") & F.col("video_id").isNotNull()).alias("usable")).join(best, "video_id", "left")
    error = F.when(~F.col("usable"), P.NOTHING_TO_SUMMARIZE).when(F.col("summary").isNull(), P.NO_SUMMARY)
    return every.select("video_id", "summary", error.alias("error"))


def save_summaries(results: DataFrame, folder: str, version: int = P.SUMMARY_VERSION, scratch: Scratch | None = None) -> None:
    """Stores summaries (video_id, summary, made_at) with their version in the table of videos, each under the conditions of merge_summaries.

    Only the buckets of videos with a result that can be stored are read and written; saving the same results again changes nothing.
    """
    with Scratch(results.sparkSession) as own:
        _store(own(results.select("video_id", "summary", "made_at")), folder, version)


def _store(results: DataFrame, folder: str, version: int) -> None:
    """save_summaries of results that are written already. The buckets are read while they are written anew, and replaced when all of that is done."""
    ids = index.storable(results).select("video_id")
    videos = tables.load_for_videos(results.sparkSession, folder, "videos", ids)
    tables.save_table(index.merge_summaries(videos, results, version), folder, "videos", "overwrite")


def summarize_stored(spark, folder: str, generator=None, version: int = P.SUMMARY_VERSION, refresh: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(video_id, summary, cached, error) of every indexed video: stored summaries of this version as they are, the others made and stored.

    ``refresh`` makes them all anew. A reply that could not be read is returned, but not stored, so the next run tries it again.
    """
    videos = tables.load_table(spark, folder, "videos")
    chunks = tables.load_table(spark, folder, "chunks").select("video_id", "chunk_id", "text")
    ready = index.indexed_videos(videos, chunks)
    cached = index.cached_summaries(videos, chunks, version)
    due = written(index.videos_to_process(ready, cached, refresh).select("video_id"), scratch)
    stored = written(cached.join(due, "video_id", "left_anti").select("video_id", "summary", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")), scratch)
    made = summarize_videos(chunks.join(due, "video_id", "left_semi"), generator, scratch).withColumn("made_at", F.current_timestamp())
    made = written(made, scratch)
    _store(made, folder, version)
    with_version = F.when(F.col("summary").isNotNull(), F.col("summary").withField("version", F.lit(version)))
    return stored.unionByName(made.select("video_id", with_version.alias("summary"), F.lit(False).alias("cached"), "error"))
