"""Rule bitmask ledger: each rule is evaluated once; failures are bits, policies are masks over them.

Native: column expressions only, without a shuffle; a text never leaves its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import WHITE, table, text_or_empty, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; its bit is the rule's place in RULES, which only grows."""

    name: str
    fails: str


#: The order gives the bits: append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "10 * n_upper > 6 * n_letters"),
)

#: Versions of the policy: a document is dropped if it fails any rule of the set.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "long_words", "short_words", "duplicate_lines", "shouting"),
}
BASE_POLICY, CURRENT_POLICY = 1, 2


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[name] for name in set(rules))


def repeat_words(w: Column) -> Column:
    """How many words of the array lie in a 3-word window that occurs twice or more in it.

    The windows' 64-bit hashes are sorted with their positions, so equal windows are neighbours:
    n log n in the words, whatever repeats. The sort is skipped where all windows differ.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    hashes = F.when(n >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(n < 3, F.lit(0)).otherwise(
        F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))
    )


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs more than once."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def with_sorted(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def widths(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    # transform over a one-element array names a value, so that it is computed once
    return F.element_at(F.transform(F.array(keyed), lambda s: widths(with_sorted(s))), 1)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``_m`` of all measurements; a null text counts as empty."""
    t = text_or_empty(text)
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return (
        docs.withColumn("_t", t)
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", lines)
        .withColumn(
            "_m",
            F.struct(
                F.size("_w").cast("long").alias("n_words"),
                (F.length("_t") - _count(F.col("_t"), WHITE)).cast("long").alias("word_chars"),
                _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
                F.size("_l").cast("long").alias("n_lines"),
                _count(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
                _count(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").cast("long").alias("n_letters"),
            ),
        )
        .drop("_t", "_w", "_l")
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, every measurement, and ``bits`` (bit i: rule i fails).

    Null and empty texts have no words, so they fail ``few_words`` alone. Repeated rows stay repeated;
    columns other than key and text are not looked at.
    """
    m = measure(docs.select(F.col(key).alias(key), F.col(text).alias("text")), "text").select(key, "_m.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return m.withColumn("bits", out.cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Adds base_failed and kept, from the stored bits alone."""
    fails = lambda v: F.col("bits").bitwiseAND(F.lit(mask(POLICIES[v]))) != 0
    return rows.withColumn("base_failed", fails(BASE_POLICY)).withColumn(
        "kept", ~(fails(BASE_POLICY) | fails(version))
    )


def ablation(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail it alone (kept if it were dropped), rows kept now.

    From the stored bits alone: rows are counted per mask (2 to the power of the rules at most), and the masks are
    tested for each rule's bit. An empty ledger gives zeros.
    """
    m = mask(POLICIES[version])
    masks = rows.groupBy(F.col("bits").bitwiseAND(F.lit(m)).alias("mask")).agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1])
    nothing = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("n"))  # a row of each rule
    tested = masks.union(nothing).select("mask", "n", F.explode(every).alias("r"))
    count = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    has = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return tested.groupBy("r.rule").agg(count(has, "failed"), count(F.col("mask") == F.col("r.bit"), "failed_alone"), count(F.col("mask") == 0, "kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits", "base_failed", "kept"
    )


#: List positions are from 1; a window is told by its text, so nothing here depends on a hash.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
         generate_subscripts(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i
  FROM d
), win AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM win WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id,
         len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS l,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')))::BIGINT AS n_letters
  FROM d LEFT JOIN covered c ON c.rid = d.rid
), b AS (
  SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM m
), f AS (
  SELECT *,
         (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
          + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
          + CASE WHEN 2 * n_dup_lines > len(l) THEN 32 ELSE 0 END
          + CASE WHEN 10 * n_upper > 6 * n_letters THEN 64 ELSE 0 END)::BIGINT AS bits
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, bits = 0 AS kept
FROM f
"""


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")))


ABLATION_SQL = f"""
WITH ledger AS ({SQL}), rules AS (
  SELECT unnest([{", ".join(f"'{r.name}'" for r in RULES)}]) AS rule, unnest([{", ".join(str(1 << i) for i in range(len(RULES)))}]) AS bit
), masks AS (SELECT bits, count(*) AS n FROM ledger GROUP BY bits)
SELECT rule, coalesce(sum(n) FILTER (bits & bit <> 0), 0)::BIGINT AS failed, coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS failed_alone,
       coalesce(sum(n) FILTER (bits = 0), 0)::BIGINT AS kept
FROM rules LEFT JOIN masks ON true GROUP BY rule
"""
