"""Preference formatting: the longest common turn prefix of two conversations is the prompt, rendered once.

Native. All work is on single turns (joins and sums by pair and turn), so a conversation of any length is
spread over tasks; a pair's parts are put together at the end, by blocks of turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import table

#: Turns are summed in blocks of so many turn numbers, then over the blocks.
TURNS_PER_BLOCK = 1000
TRAINED_ROLE = "assistant"


def render(role: Column, text: Column) -> Column:
    """``<|role|>``, line feed, text, ``<|end|>``, line feed. ``<|`` within the text becomes ``< |``."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def pairs(conversations: DataFrame) -> DataFrame:
    """Turns (pair_id, side, turn, role, text) of paired conversations, from (conv_id, turn, role, text).

    Conversation 2k is the chosen side of pair k. The rejected side keeps the first half of its turn numbers
    and goes on with those of conversation 2k + 1. Rows without conv_id are in no pair; a null turn counts as
    turn -1, a null role or text as empty.
    """
    c = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        (F.pmod("conv_id", F.lit(2)) == 0).alias("even"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    half = c.groupBy("pair_id").agg(F.floor((F.coalesce(F.max(F.when(F.col("even"), F.col("turn"))), F.lit(-1)) + 1) / 2).alias("half"))
    first = F.col("turn") < F.col("half")
    sides = F.array_compact(
        F.array(F.when(F.col("even"), F.lit("chosen")), F.when(first == F.col("even"), F.lit("rejected")))
    )
    return c.join(half, "pair_id").select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, rendered, start, trained.

    The prompt holds the turns before the first turn number at which the sides differ (a turn that only one
    side has is a difference); equal sides are all prompt, and so is nothing of a pair with an empty side.
    ``start`` is the turn's code point offset in its part, so that the parts can be put together in any system;
    ``trained`` marks the assistant's turns of a completion, on which a loss is taken; the prompt has none.
    Rows with one turn number are ordered by role and text and compared as a bag; other columns are dropped.
    """
    t = turns.select("pair_id", "side", "turn", "role", "text")
    h = F.xxhash64("role", "text")
    is_chosen = F.col("side") == "chosen"
    at = t.groupBy("pair_id", "turn").agg(
        *[
            F.sum(F.when(side, v).otherwise(F.lit(0).cast("decimal(38,0)"))).alias(n)
            for side, k in ((is_chosen, "c"), (~is_chosen, "r"))
            for v, n in ((F.lit(1).cast("decimal(20,0)"), f"{k}n"), (h.cast("decimal(20,0)"), f"{k}h"))
        ]
    )
    differ = (F.col("cn") != F.col("rn")) | (F.col("ch") != F.col("rh"))
    ends = at.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("end"))
    common = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    rows = (
        t.join(ends, "pair_id")
        .filter(~common | is_chosen)
        .select(
            "pair_id",
            F.when(common, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
            "turn",
            "role",
            render(F.col("role"), F.col("text")).alias("rendered"),
            (~common & (F.col("role") == TRAINED_ROLE)).alias("trained"),
        )
        .withColumn("_b", F.floor(F.col("turn") / TURNS_PER_BLOCK))
        .withColumn("_n", F.length("rendered").cast("long"))
    )
    by = ["pair_id", "part", "_b"]
    sums = rows.groupBy(*by).agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("pair_id", "part").orderBy("_b")) - F.col("_s")
    within = F.sum("_n").over(
        Window.partitionBy(*by).orderBy("turn", "role", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_w", F.coalesce(within, F.lit(0)))
        .join(sums.select(*by, before.alias("_before")), by)
        .select("pair_id", "part", "turn", "role", "rendered", (F.col("_before") + F.col("_w")).alias("start"), "trained")
    )


def paired(rows: DataFrame) -> DataFrame:
    """pair_id, block, prompt, chosen, rejected, chosen_spans, rejected_spans, and where each part's text here begins in it.

    One row per pair; one with turn numbers beyond TURNS_PER_BLOCK has a row per block of them, so no row grows
    without bound, and the blocks' texts put together are the parts. Spans are (start, end) of the trained turns, as code point
    offsets in the whole part: what a loss is taken on. A side without turns after the prompt is empty.
    """
    def at(part: str) -> Column:
        mine = F.col("part") == part
        return F.array_sort(F.collect_list(F.when(mine, F.struct("start", "rendered", "trained"))))

    parts = ("prompt", "chosen", "rejected")
    n = F.floor(F.col("turn") / TURNS_PER_BLOCK).cast("long")
    g = rows.groupBy("pair_id", n.alias("block")).agg(*[at(p).alias(f"_{p}") for p in parts])
    text = lambda p: F.array_join(F.transform(f"_{p}", lambda x: x["rendered"]), "")
    span = lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["rendered"])).alias("end"))
    spans = lambda p: F.transform(F.filter(f"_{p}", lambda x: x["trained"]), span)
    return g.select(
        "pair_id", "block", *[text(p).alias(p) for p in parts], *[spans(p).alias(f"{p}_spans") for p in parts[1:]],
        *[F.get(f"_{p}", F.lit(0))["start"].alias(f"{p}_start") for p in parts],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their masks written out, "start-end" of each trained span by commas."""
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(c)
    cols = ["pair_id", "block", "prompt", "chosen", "rejected", mask("chosen_spans"), mask("rejected_spans")]
    return paired(turns(spark, sf_dir)).select(*cols)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of all pairs."""
    return format_pairs(pairs(table(spark, sf_dir, "conversations")))


TURNS_SQL = r"""
WITH c AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS even, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT pair_id, floor((coalesce(max(turn) FILTER (even), -1) + 1) / 2) AS half FROM c GROUP BY pair_id
), t AS (
  SELECT c.pair_id, 'chosen' AS side, turn, role, text FROM c WHERE even
  UNION ALL
  SELECT c.pair_id, 'rejected', turn, role, text FROM c JOIN h USING (pair_id) WHERE (turn < half) = even
), g AS (
  SELECT pair_id, turn, string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) FILTER (side = 'chosen') AS a,
         string_agg(role || chr(1) || text, chr(2) ORDER BY role, text) FILTER (side = 'rejected') AS b
  FROM t GROUP BY pair_id, turn
), e AS (
  SELECT pair_id, min(turn) FILTER (a IS DISTINCT FROM b) AS stop FROM g GROUP BY pair_id
), r AS (
  SELECT t.pair_id, CASE WHEN stop IS NULL OR turn < stop THEN 'prompt' ELSE side END AS part, side, turn, role,
         '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered
  FROM t JOIN e USING (pair_id)
)
SELECT pair_id, part, turn, role, rendered,
       coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       part <> 'prompt' AND role = 'assistant' AS trained
FROM r WHERE part <> 'prompt' OR side = 'chosen'
"""

SQL = f"""
WITH rows AS ({TURNS_SQL})
SELECT pair_id, floor(turn / {TURNS_PER_BLOCK})::BIGINT AS block,
       coalesce(string_agg(rendered, '' ORDER BY start) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY start) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY start) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(start || '-' || (start + length(rendered)), ',' ORDER BY start) FILTER (part = 'chosen' AND trained), '') AS chosen_spans,
       coalesce(string_agg(start || '-' || (start + length(rendered)), ',' ORDER BY start) FILTER (part = 'rejected' AND trained), '') AS rejected_spans
FROM rows GROUP BY ALL
"""
