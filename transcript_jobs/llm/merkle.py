"""Merkle fingerprints: text -> sections -> paragraphs (lines) -> pieces (sentences, at most 40 characters).

Native: column expressions, one shuffle of the texts to set each one beside its successor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import table, text_or_empty

#: A leaf of the tree. Sentence ends anchor the pieces, so an edit moves no boundary beyond its sentence.
PIECE = r"[^.!?]{1,40}[.!?]*|[.!?]+"
#: A paragraph whose digest begins with one of these ends its section: the same sections again after an edit elsewhere.
SECTION_ENDS = "[08]"
_LEAST = -(2**63)
#: Bytes of text of a key range, about; ranges at most, as a key of each is sent to the driver.
RANGE_BYTES, MOST_RANGES = 64 << 20, 10_000


def fingerprint(text: Column) -> Column:
    """``root|sections|leaves``: the root's md5, 8 hex digits of each section and of each leaf.

    Paragraphs are parted by ``.`` and sections by ``;`` in the leaves' field. Equal texts have equal
    fingerprints and different texts different roots. The empty text is one paragraph without leaves.
    """
    pieces = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), 0), F.md5))
    nodes = F.transform(
        pieces,
        lambda m: F.concat(
            F.md5(F.array_join(m, "")), F.array_join(F.transform(m, lambda x: F.substring(x, 1, 8)), "")
        ),
    )
    marked = F.transform(nodes, lambda n: F.concat(n, F.when(n.rlike("^" + SECTION_ENDS), ";").otherwise(".")))
    sections = F.split(F.regexp_replace(F.array_join(marked, ""), "[;.]$", ""), ";")

    def whole(s: Column) -> Column:
        digests = F.transform(s, F.md5)
        leaves = F.transform(s, lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda n: F.substr(n, F.lit(33))), "."))
        return F.concat_ws(
            "|",
            F.md5(F.array_join(digests, "")),
            F.array_join(F.transform(digests, lambda d: F.substring(d, 1, 8)), "."),
            F.array_join(leaves, ";"),
        )

    return F.element_at(F.transform(F.array(sections), whole), 1)


def leaves(fp: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.element_at(F.split(fp, r"\|"), 3), F.lit("[0-9a-f]{8}"), 0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal roots, else twice the common leaves by the leaves of both (0 where either has none)."""
    la, lb = leaves(a), leaves(b)
    dice = 2.0 * F.size(F.array_intersect(la, lb)) / (F.size(la) + F.size(lb))
    return F.when(a == b, F.lit(1.0)).when((F.size(la) == 0) | (F.size(lb) == 0), F.lit(0.0)).otherwise(dice)


def changed_sections(a: Column, b: Column) -> Column:
    """Places (from 0) of the sections of ``b`` that ``a`` has not: where the branches differ."""
    parts = lambda fp: F.split(F.element_at(F.split(fp, r"\|"), 2), r"\.")
    return F.filter(
        F.transform(parts(b), lambda d, i: F.when(~F.array_contains(parts(a), d), i)), lambda i: i.isNotNull()
    )


def _place(bounds: list[int], k: Column) -> Column:
    """How many of the rising bounds are at most k, by halving."""
    if not bounds:
        return F.lit(0)
    every = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(every, at + step - 1) <= k, F.lit(False)), step).otherwise(0)
    )


def with_next(docs: DataFrame, key: str, text: str, more: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with _more (made of the text) and next_<text>, next__more: those of the row that follows by (key, text), the first row after the last.

    Rows are cut into key ranges of about RANGE_BYTES by approximate quantiles, and the first row of each range is
    also put as a guest at the end of the range before it; so one shuffle does, of the texts alone, and no task
    holds more than one range. What reaches the driver is one key per range. Null keys come first. Rows of one key
    are one range.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    n = min(MOST_RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    bounds = docs.agg(F.percentile_approx(k, [i / n for i in range(1, n)], 20 * n).alias("b")).head()["b"] or []
    ranged = docs.withColumn("_k", k).withColumn("_r", _place(sorted(set(bounds)), F.col("_k")))
    firsts = sorted((r["_r"], r["k"]) for r in ranged.groupBy("_r").agg(F.min("_k").alias("k")).collect())
    guests = [(k0, firsts[i - 1][0]) for i, (_, k0) in enumerate(firsts)]
    of = spark.createDataFrame(guests, "_k long, _g int")
    place = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("guest"))
    own = F.array(place(F.col("_r"), False))
    both = ranged.join(F.broadcast(of), "_k", "left").withColumn(
        "_p", F.explode(F.when(F.col("_g").isNull(), own).otherwise(F.concat(own, F.array(place(F.col("_g"), True)))))
    )
    sent = both.select(key, text, "_k", "_p.r", "_p.guest").repartition(n, "r").withColumn("_more", more(F.col(text)))
    w = Window.partitionBy("r").orderBy("guest", "_k", text)
    return (
        sent.withColumn(f"next_{text}", F.lead(text).over(w)).withColumn("next__more", F.lead("_more").over(w)).filter("NOT guest").drop("_k", "r", "guest")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by the beginning of the next document's.
    A null text counts as empty; an empty or very short text equals its edited text (likeness 1). Rows with
    one key are ordered by text; repeated rows each get a result. Other columns of ``docs`` are not looked at.
    """
    d = docs.select(F.col(key).alias("_id"), text_or_empty(text).alias("_t"))
    d = with_next(d, "_id", "_t", fingerprint).withColumnsRenamed({"_more": "_f", "next__more": "next__f"})
    n = F.length("_t")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("_t", F.lit(1), n - quarter), F.substr("next__t", F.lit(1), quarter))
    return (
        d.withColumn("_e", edited)
        .withColumn("_ef", F.when(F.col("_e") == F.col("_t"), F.col("_f")).otherwise(fingerprint(F.col("_e"))))
        .select(
            F.col("_id").alias(key),
            n.cast("long").alias("n_chars"),
            F.sha2("_e", 256).alias("edited_sha256"),
            F.col("_f").alias("fingerprint"),
            F.col("_ef").alias("edited_fingerprint"),
            likeness(F.col("_f"), F.col("_ef")).alias("near_edited"),
            likeness(F.col("_f"), F.col("next__f")).alias("near_next"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _fp_sql(source: str, text: str) -> str:
    """Select of rid and fp for the rows of ``source``."""
    return f"""
  SELECT rid, md5(array_to_string(list_transform(s, lambda x: md5(x)), '')) || '|'
         || array_to_string(list_transform(s, lambda x: left(md5(x), 8)), '.') || '|'
         || array_to_string(list_transform(s, lambda x: array_to_string(list_transform(string_split(x, '.'), lambda n: substr(n, 33)), '.')), ';') AS fp
  FROM (
    SELECT rid, string_split(regexp_replace(array_to_string(list_transform(nodes, lambda n: n || CASE WHEN left(n, 1) IN ('0', '8') THEN ';' ELSE '.' END), ''), '[;.]$', ''), ';') AS s
    FROM (
      SELECT rid, list_transform(pieces, lambda m: md5(array_to_string(m, '')) || array_to_string(list_transform(m, lambda x: left(x, 8)), '')) AS nodes
      FROM (
        SELECT rid, list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{{1,40}}[.!?]*|[.!?]+'), lambda x: md5(x))) AS pieces
        FROM {source}
      )
    )
  )"""


_NEAR = """CASE WHEN {a} = {b} THEN 1.0 WHEN len({a}l) = 0 OR len({b}l) = 0 THEN 0.0
       ELSE 2.0 * len(list_intersect({a}l, {b}l)) / (len({a}l) + len({b}l)) END::DOUBLE"""
_LEAVES = "list_distinct(regexp_extract_all(string_split({f}, '|')[3], '[0-9a-f]{{8}}'))"

SQL = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rid, doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY rid), first_value(t) OVER (ORDER BY rid)) AS nt,
         CASE WHEN rid = count(*) OVER () THEN 1 ELSE rid + 1 END AS nrid
  FROM d
), e AS (
  SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS ed FROM n
), f AS ({_fp_sql("e", "t")}), g AS ({_fp_sql("e", "ed")}
), j AS (
  SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.ed) AS edited_sha256, f.fp AS a, g.fp AS b, x.fp AS c,
         {_LEAVES.format(f="f.fp")} AS al, {_LEAVES.format(f="g.fp")} AS bl, {_LEAVES.format(f="x.fp")} AS cl
  FROM e JOIN f ON f.rid = e.rid JOIN g ON g.rid = e.rid JOIN f x ON x.rid = e.nrid
)
SELECT doc_id, n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint,
       {_NEAR.format(a="a", b="b")} AS near_edited, {_NEAR.format(a="a", b="c")} AS near_next
FROM j
"""
