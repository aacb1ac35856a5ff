"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of docs, whatever they are beside doc_id, text and source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm import mixing, near_dups, packing, quality_model, toxicity
from transcript_jobs.llm.common import Aside, Scratch, among, shared_dir, table

#: Near copies have a similarity of 0.8 or more (op2 alone links from 0.85 on).
NEAR_PERCENT = 80


def _accepted(docs: DataFrame, score: Callable[[DataFrame], DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """Rows of docs whose score is to keep; a column of docs that is called score stays as it is."""
    own = Aside(docs)
    texts = own.df.withColumnRenamed(own.here("text"), "text")
    return score(texts).filter(keep(F.col("score"))).withColumnRenamed("text", own.here("text")).select(*own.back())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept, trained on the labelled ones among them."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return _accepted(docs, lambda d: quality_model.score(d, model), lambda s: s >= quality_model.ACCEPT)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _accepted(docs, lambda d: toxicity.score(d, model), lambda s: s < toxicity.ACCEPT)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; of rows with one doc_id, that of the least text. Rows without stay.

    Only rows that may go are shuffled: the others are told by a bitmap of bounded size.
    """
    own = Aside(docs)
    rows = own.df.withColumn("k", own("doc_id").cast("long"))
    ids = rows.select("k", own("text").alias("text"))
    found = Scratch(spark, "dedup").put(near_dups.near_duplicates(ids, "k", percent=NEAR_PERCENT).filter("k IS NOT NULL"), "found")
    many = found.groupBy("k").count().filter("count > 1").select("k")
    gone = found.filter("NOT kept").select("k").distinct()
    rest = among(rows, "k", gone, "left_anti")
    if not many.isEmpty():
        own_row = F.struct(*rows.columns)
        one = F.min_by(own_row, F.struct(own("text").alias("t"), F.to_json(own_row).alias("j")))
        repeated = rest.join(many, "k").groupBy("k").agg(one.alias("r")).select("r.*")
        rest = rest.join(many, "k", "left_anti").select(*rows.columns).unionByName(repeated)
    return rest.select(*own.back())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as their source is gone through, and in part at the end of its budget (n_chars follows the text)."""
    own = Aside(docs)
    used = {own.here(n): n for n in ("doc_id", "text", "source")}
    safe = own.df.withColumnsRenamed(used)
    out = mixing.apply_mix(mixing.mix(safe)).withColumnsRenamed({n: x for x, n in used.items()})
    if "n_chars" not in docs.columns:
        return out.select(*own.back())
    return out.select(*own.back(n_chars=F.length(own("text")).cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dups", dedup), ("mixing", mix), ("packing", pack)]
#: Two stages are trained models and one a tokenizer; the tests follow a small corpus through by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; what lies between is written to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
