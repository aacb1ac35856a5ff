"""Summaries in two steps: plans, batches, prompts, sections, the second attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions.text import strip, summary_line_count, word_count
from transcript_jobs.operators.questions import messages

CHUNK_SYSTEM = (
    "Summarize a piece of a video transcript in {rule}. Use nothing but the piece; keep technical details, names and numbers; leave "
    "out fillers and repetition. Reply with the summary alone."
)
FINAL_SYSTEM = (
    "Write one detailed summary of a video from {source}, using nothing else. Reply with one JSON object with the keys summary_lines "
    "(at least 15 sentences of 12 to 25 words, in the video's order, each with another fact), main_topics (4 phrases), key_points "
    "(4 sentences) and conclusions (2 sentences). Within the texts use single quotes and no backslashes. No code fences."
)
FINAL_END = "\n\nNow write the JSON object: 15 or more summary_lines, 4 main_topics, 4 key_points, 2 conclusions."


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a text that isn't blank."""
    return chunks.filter(_usable())


def _usable() -> Column:
    return strip(F.coalesce("text", F.lit(""))) != ""


def _rule(i: int) -> Column:
    out = F.lit(P.LENGTH_RULES[-1][i])
    for rule in P.LENGTH_RULES[-2::-1]:
        out = F.when(F.col("n_chunks") >= rule[0], F.lit(rule[i])).otherwise(out)
    return out


def _plan() -> list[Column]:
    mode = F.when(F.col("total_words") <= P.DIRECT_WORDS, "direct").otherwise("map_reduce")
    return [mode.alias("mode"), _rule(1).alias("max_tokens"), _rule(2).alias("length_rule")]


def summary_plan(chunks: DataFrame) -> DataFrame:
    """(video_id, n_chunks, total_words, mode, max_tokens, length_rule) of each video with usable chunks."""
    plan = usable_chunks(chunks).groupBy("video_id").agg(F.count("*").alias("n_chunks"), F.sum(word_count(F.col("text"))).alias("total_words"))
    return plan.select("*", *_plan())


def planned_chunks(chunks: DataFrame) -> DataFrame:
    """Usable chunks with the columns of their video's summary_plan: one shuffle, and the chunks are made once."""
    by = Window.partitionBy("video_id")
    rows = usable_chunks(chunks).withColumn("n_chunks", F.count("*").over(by)).withColumn("total_words", F.sum(word_count(F.col("text"))).over(by))
    return rows.select("*", *_plan())


def planned_with_unusable(chunks: DataFrame) -> DataFrame:
    """planned_chunks and the unusable chunks beside them, told apart by ``usable``; a plan counts usable ones alone."""
    by, own = Window.partitionBy("video_id"), F.col("usable")
    rows = chunks.withColumn("usable", _usable()).withColumn("n_chunks", F.count(F.when(own, 1)).over(by))
    return rows.withColumn("total_words", F.sum(F.when(own, word_count(F.col("text")))).over(by)).select("*", *_plan())


def length_batches(chunks: DataFrame, size: int = P.SUMMARY_BATCH) -> DataFrame:
    """Chunks with ``batch_id``: a video's texts by falling length, in batches of ``size``."""
    order = Window.partitionBy("video_id").orderBy(F.desc(F.length("text")), "chunk_id")
    return chunks.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def batch_stats(batches: DataFrame) -> DataFrame:
    """(video_id, batch_id, chunks, input_words)."""
    return batches.groupBy("video_id", "batch_id").agg(F.count("*").alias("chunks"), F.sum(word_count(F.col("text"))).alias("input_words"))


def chunk_prompts(planned: DataFrame) -> DataFrame:
    """Of planned_chunks those of map_reduce videos, with ``messages``."""
    system = F.replace(F.lit(CHUNK_SYSTEM), F.lit("{rule}"), F.col("length_rule"))
    user = F.concat(F.lit("Transcript excerpt:\n\n"), strip(F.col("text")))
    return planned.filter("mode = 'map_reduce'").withColumn("messages", messages(system, user)).drop("length_rule")


def combine_sections(sections: DataFrame) -> DataFrame:
    """(video_id, mode, combined) of rows (video_id, chunk_id, mode, text), text being the chunk's or its summary's.

    Direct: texts by blank lines; map_reduce: each headed "Section <id>: ". Empty ones are left out, in chunk order.
    """
    head = F.when(F.col("mode") == "map_reduce", F.concat(F.lit("Section "), F.col("chunk_id").cast("string"), F.lit(": "))).otherwise("")
    part = F.struct("chunk_id", F.concat(head, strip(F.col("text"))).alias("part"))
    rows = sections.filter(strip(F.coalesce("text", F.lit(""))) != "")
    joined = rows.groupBy("video_id", "mode").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return joined.select("video_id", "mode", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("combined"))


def final_prompts(combined: DataFrame) -> DataFrame:
    """Adds ``messages`` to rows (video_id, mode, combined)."""
    direct = F.col("mode") == "direct"
    source = F.when(direct, "its transcript").otherwise("summaries of its sections, in order")
    system = F.replace(F.lit(FINAL_SYSTEM), F.lit("{source}"), source)
    user = F.concat(F.when(direct, "Transcript:\n\n").otherwise("Section summaries:\n\n"), "combined", F.lit(FINAL_END))
    return combined.withColumn("messages", messages(system, user))


def is_short() -> Column:
    """Whether a first attempt (…, summary struct) was parsed and has fewer lines than asked for."""
    return F.col("summary.raw_output").isNull() & (summary_line_count(F.col("summary.summary")) < P.SUMMARY_LINES)


def needs_retry(first: DataFrame) -> DataFrame:
    """First attempts (…, summary struct) with fewer lines than asked for; unparsed ones aren't tried again."""
    return first.filter(is_short())


def retry_prompts(short: DataFrame) -> DataFrame:
    """Rows (messages, summary) with a reminder of the line count at the end of the last message."""
    n = summary_line_count(F.col("summary.summary")).cast("string")
    more = F.concat(F.lit("\n\nYour last reply had only "), n, F.lit(f" summary_lines. Write at least {P.SUMMARY_LINES}, each with another fact."))
    again = F.transform(
        "messages",
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(i == F.size("messages") - 1, F.concat(m["content"], more)).otherwise(m["content"]).alias("content"),
        ),
    )
    return short.withColumn("messages", again)


def select_attempt(first: DataFrame, retry: DataFrame) -> DataFrame:
    """(video_id, summary): the second attempt where it was parsed and has more lines, else the first."""
    r = retry.select("video_id", F.col("summary").alias("_r"))
    lines = lambda c: summary_line_count(F.col(c))
    better = F.col("_r").isNotNull() & F.col("_r.raw_output").isNull() & (lines("_r.summary") > lines("summary.summary"))
    asked = F.col("summary.raw_output").isNull() & (lines("summary.summary") < P.SUMMARY_LINES)
    return first.join(r, "video_id", "left").select("video_id", F.when(asked & better, F.col("_r")).otherwise(F.col("summary")).alias("summary"))
