"""Mixing sources to target weights: complete epochs first, then Efraimidis-Spirakis order up to the word budget.

Native. A source's order is dealt out by ranges of the sampling key, so a source with a third of all rows is
summed by many tasks: sums per range, prefix sums over the ranges, and the order within one range, where the budget
ends. A row then tells by its own key whether it is before that end; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import WHITE_CLASS, Aside, Scratch, md5_unit, table, text_or_empty

#: Weights of the sources in order, repeating; the share of all words; the most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
SEED = 17
ROWS_PER_RANGE = 10_000
LEAST_WEIGHT = 1e-3
WORD = r"[^\x20\x09-\x0D]+"
#: Columns that a mix adds.
NEW = ("size", "source_size", "target", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """1 to 4: less for a text with many symbols among its words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(size > 0, 4.0 - 3.0 * F.least(F.lit(1.0), symbols / size)).otherwise(F.lit(1.0))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to the rows (sn, s0, source_size), one per source.

    Weights go round by the sources' order. A target stops at MOST_EPOCHS times the source's size; what is
    over goes to the others by weight. Sources fill in the order of cap by weight, so prefix sums tell which
    are full. The windows hold one row per source.
    """
    i = F.row_number().over(Window.orderBy("sn", "s0")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "sn", "s0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("goal", F.sum("source_size").over(every) * SHARE)
    caps_before = F.sum("cap").over(order) - F.col("cap")
    w_from = F.sum("w").over(every) - F.sum("w").over(order) + F.col("w")
    s = s.withColumn("full", F.col("cap") * w_from <= (F.col("goal") - caps_before) * F.col("w"))
    left = F.col("goal") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    return s.withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / open_w)
    ).select("sn", "s0", "source_size", "target")


def _order() -> Column:
    """A row's place in its source: what is taken first is least."""
    return F.struct((-F.col("u")).alias("u"), "id", "h")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """Adds to ``docs``, its columns under the names of Aside, what the mix needs of a row: id, h, size, sn, s0, and the sampling key u.

    u is a number in (0, 1) from the md5 of key and seed, to the power of 1 by the weight. Weights are those of
    the column ``weight`` (null, or not above 0, counts as the least weight there can be), else quality_weight.
    """
    a = Aside(docs)
    t = text_or_empty(a(text))
    size = F.regexp_count(t, F.lit(WORD)).cast("long")
    given = F.greatest(F.coalesce(a(weight).cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT)) if weight else quality_weight(t, size)
    return a.df.select(
        "*",
        a(key).alias("id"),
        F.xxhash64(t).alias("h"),
        size.alias("size"),
        a(source).isNull().alias("sn"),
        F.coalesce(a(source).cast("string"), F.lit("")).alias("s0"),
        F.pow(md5_unit(F.lit(str(SEED)), a(key).cast("string")), 1.0 / given).alias("u"),
    )


def ends(rows: DataFrame, work: Scratch) -> DataFrame:
    """A table (sn, s0, source_size, target, epochs, rest, cut, copies, left) per source, from measured rows without their texts.

    ``rest`` words are taken after whole epochs; they end within the rows at ``cut`` in the order, of which there
    are ``copies``, alike in key and text; these have ``left`` words of the rest. No cut: the rest takes all or none.
    Sums per range of u, prefix sums over ranges, and only the range where the rest ends is put in order.
    """
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    rows = rows.withColumn("r", F.floor((1.0 - F.col("u")) * ranges).cast("long"))
    sums = rows.groupBy("sn", "s0", "r").agg(F.sum("size").alias("s"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = targets(sums.groupBy("sn", "s0").agg(F.sum("s").alias("source_size"))).withColumn("epochs", epochs)
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    before = F.sum("s").over(Window.partitionBy("sn", "s0").orderBy("r")) - F.col("s")
    last = sums.withColumn("before", before).join(goal.select("sn", "s0", "rest"), ["sn", "s0"])
    last = last.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s"))).select("sn", "s0", "r", (F.col("rest") - F.col("before")).alias("left"))
    last = work.put(last, "last")  # a row per source: its size tells how it is joined
    alike = rows.join(last, ["sn", "s0", "r"]).groupBy("sn", "s0", "u", "id", "h").agg(F.sum("size").alias("s"), F.count("*").alias("copies"), F.min("left").alias("left"))
    left = F.col("left") - (F.sum("s").over(Window.partitionBy("sn", "s0").orderBy(_order())) - F.col("s"))
    cut = alike.withColumn("left", left).filter((F.col("left") >= 0) & (F.col("left") < F.col("s")))
    return work.put(goal.join(cut.select("sn", "s0", _order().alias("cut"), "copies", "left"), ["sn", "s0"], "left"), "ends")


def _taken() -> Column:
    """Words that the mix takes of a row beside the end of its source."""
    part = F.when(F.col("cut").isNull(), F.when(F.col("rest") >= F.col("source_size"), F.col("size")).otherwise(0)).otherwise(
        F.when(_order() < F.col("cut"), F.col("size")).when(_order().eqNullSafe(F.col("cut")), F.floor(F.col("left") / F.col("copies"))).otherwise(0)
    )
    return (F.col("epochs") * F.col("size") + part).cast("long")


_NARROW = ["id", "h", "size", "sn", "s0", "u"]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    A row is taken ``floor(target / source_size)`` times whole; the rest of the source's target is filled in
    descending order of u ** (1 / weight) (see measured), and the last document is cut where the budget ends; if
    that is one of several rows alike in key and text, they share what is left. A null text has no words, a null
    source is a source of its own (last in order). Columns of ``docs`` named like the new ones, in upper or lower
    case, are replaced. Rows stay where they are: only sizes and sampling keys are shuffled, and a row per source
    is joined.
    """
    a, work = Aside(docs), Scratch(docs.sparkSession, "mixing")
    rows = measured(docs, key, text, source, weight)
    own = ends(work.put(rows.select(*_NARROW), "rows"), work)
    work.keep("ends")
    return rows.join(own, ["sn", "s0"]).select(*a.back(without=NEW), "size", "source_size", "target", _taken().alias("taken"))


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """key, size, source_size, target, taken of mix: the texts are gone through once."""
    work = Scratch(docs.sparkSession, "mixing")
    rows = work.put(measured(docs, key, text, source, weight).select(*_NARROW), "rows")
    own = ends(rows, work)
    work.keep("rows", "ends")
    return rows.join(own, ["sn", "s0"]).select(F.col("id").alias(key), "size", "source_size", "target", _taken().alias("taken"))


def apply_mix(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the mix holds, without what mix added: each document once per whole time it is taken, and once cut after the words of the rest."""
    a = Aside(mixed)
    size, taken = a("size"), a("taken")
    whole = F.floor(taken / F.greatest(size, F.lit(1))).cast("int")
    part = taken - whole * size
    words = F.regexp_extract_all(a(text), F.lit(WHITE_CLASS + "*" + WORD), 0)
    piece = F.array_join(F.slice(words, 1, F.col("_n").cast("int")), "")
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = a.df.filter(taken > 0).withColumn("_n", F.explode(times))
    return rows.select(*a.back(without=NEW, **{text: F.when(F.col("_n") > 0, piece).otherwise(a(text))}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), k AS (
  SELECT doc_id, source, t, size,
         pow((('0x' || left(md5(concat_ws(':', '17', doc_id::VARCHAR)), 13))::BIGINT + 0.5) / 4503599627370496.0,
             1.0 / CASE WHEN size > 0 THEN 4.0::DOUBLE - 3.0::DOUBLE * least(1.0::DOUBLE, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::DOUBLE / size) ELSE 1.0::DOUBLE END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS goal,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM s
), f AS (
  SELECT *, cap * (sum(w) OVER () - sum(w) OVER o + w) <= (goal - (sum(cap) OVER o - cap)) * w AS is_full
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE (goal - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
  FROM f
), p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS epochs,
         (coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key DESC, k.doc_id, k.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target - epochs * source_size + 0.5)::BIGINT - before, 0), size))::BIGINT AS taken
FROM p
"""
