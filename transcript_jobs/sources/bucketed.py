"""Tables laid out for joins and windows by video: buckets by Spark's own hash of video_id, so that no exchange is needed.

A table has two levels. Its rows lie in groups of videos, the unit that a replacement rewrites, and within a group in buckets,
which Spark reads as partitions by video_id: windows, groupings and joins by video of one such table, or of several with equal
numbers of buckets, shuffle nothing. Take about a bucket per task that shall read the whole table, and as many groups as
make a batch's rewriting small: a batch of few videos touches few groups.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.sources.tables import SCHEMAS
from transcript_jobs.sources.written import Scratch, file_system

BUCKETS, GROUPS = 64, 16
_PROPERTIES = "_bucketed.json"
#: What rows are sorted by within a bucket, after the video.
_ORDER = {"segments": "seg_idx", "raw_segments": "pos", "chunks": "chunk_id", "questions": "start", "vectors": "chunk_id", "cells": "cell"}


def _group(n: int):
    return F.pmod(F.xxhash64("video_id", F.lit(3)), F.lit(n)).cast("int").alias("video_group")


def _layout(spark: SparkSession, folder: str, name: str) -> dict[str, int] | None:
    files, path = file_system(spark, f"{folder}/{name}/{_PROPERTIES}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    stored = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(stored)


def _registered(spark: SparkSession, folder: str, name: str) -> str:
    """The table's name in the session's catalog, where it is registered over its files if it isn't yet."""
    own = _layout(spark, folder, name)
    if own is None:
        raise ValueError(f"{folder}/{name} is no bucketed table")
    called = f"{name}_{hashlib.md5(folder.encode()).hexdigest()[:12]}"
    if not spark.catalog.tableExists(called):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], SCHEMAS[name]).schema)
        order = ", ".join(["video_id", *filter(None, [_ORDER.get(name)])])
        spark.sql(
            f"CREATE TABLE {called} ({columns}, video_group int) USING parquet PARTITIONED BY (video_group) "
            f"CLUSTERED BY (video_id) SORTED BY ({order}) INTO {own['buckets']} BUCKETS LOCATION '{folder}/{name}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {called}")
    return called


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    return _layout(spark, folder, name) is not None


def load(spark: SparkSession, folder: str, name: str, ids: DataFrame | None = None) -> DataFrame:
    """The table; with ``ids`` all rows of the groups that these videos lie in, and no file of the others is opened."""
    rows = spark.table(_registered(spark, folder, name))
    if ids is not None:
        touched = ids.select(_group(_layout(spark, folder, name)["groups"])).distinct()  # a row per group at most
        rows = rows.join(F.broadcast(touched), "video_group", "left_semi")
    return rows.drop("video_group")


def save(df: DataFrame, folder: str, name: str, buckets: int = BUCKETS, groups: int = GROUPS, overwrite: bool = False) -> None:
    """Adds rows to the table; ``overwrite`` replaces the groups that ``df`` has rows of. Buckets and groups are set by the first write.

    Rows are shuffled once, so that each file is written by one task: by bucket, and by group within it.
    """
    spark = df.sparkSession
    df = df.to(spark.createDataFrame([], SCHEMAS[name]).schema)
    own = _layout(spark, folder, name)
    if own is None:
        own = {"buckets": buckets, "groups": groups}
        files, path = file_system(spark, f"{folder}/{name}/{_PROPERTIES}")
        stream = files.create(path, True)
        stream.write(bytearray(json.dumps(own).encode()))
        stream.close()
    called = _registered(spark, folder, name)
    rows = df.select("*", _group(own["groups"])).repartition(own["buckets"], "video_id")  # the hash that buckets are made by
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(called, overwrite=overwrite)
    finally:
        spark.conf.set(mode, before)


def replace(rows: DataFrame, folder: str, name: str, ids: DataFrame, buckets: int = BUCKETS, groups: int = GROUPS) -> None:
    """Puts ``rows`` in place of all rows of the videos ``ids``: the groups of these videos are read, written aside and overwritten, others stay."""
    spark = rows.sparkSession
    rows = rows.to(spark.createDataFrame([], SCHEMAS[name]).schema)
    with Scratch(spark) as scratch:
        ids = scratch(ids.select("video_id").distinct())
        if exists(spark, folder, name):
            rows = load(spark, folder, name, ids).join(ids, "video_id", "left_anti").select(*rows.columns).unionByName(rows)
        rows = scratch(rows)
        save(rows, folder, name, buckets, groups, overwrite=True)
        n = _layout(spark, folder, name)["groups"]
        gone = ids.select(_group(n)).distinct().join(rows.select(_group(n)).distinct(), "video_group", "left_anti")
        for r in gone.collect():  # an overwrite leaves groups alone that have no row any more; a row per group at most
            spark.sql(f"ALTER TABLE {_registered(spark, folder, name)} DROP IF EXISTS PARTITION (video_group = {r['video_group']})")
            files, path = file_system(spark, f"{folder}/{name}/video_group={r['video_group']}")
            files.delete(path, True)
