"""New transcripts as they arrive: each batch is cleaned, chunked, embedded and put in place of the video's older rows.

What is done is told by the tables. Videos that are ready are passed over, so a batch that is delivered again changes
nothing and calls no model; a table is replaced by bucket, so only the buckets of a batch's videos are written.

Two logs stand beside the tables, in folders per stream and batch that are published whole and never written again:
``arrived`` has the cleaned segments, from which questions are mined, once; ``quarantine`` has the lines that could not be
read, with their file and the reason. Any number of streams may log to one folder; they write the tables one at a time.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from transcript_jobs import params as P
from transcript_jobs.jobs import flows
from transcript_jobs.operators import index, long_videos, models
from transcript_jobs.sources import tables
from transcript_jobs.sources.written import FREES_SHUFFLES, Aside, Scratch, publish, publishing, settings

ARRIVED = "video_id string, seg_idx int, start double, end double, text string"
QUARANTINE = "file string, line string, reason string"
_FIELDS = ("url", "title", "channel", "duration", "thumbnail", "language")
#: A line with its order among deliveries: when its file was written, its name and the place of the split; within a split the greater text counts.
_LINE = "file string, line string, video_id string, part int, parts int, reason string, at struct<modified: timestamp, file: string, n: long>"
#: How long a video's parts are waited for after the last of them came.
WAIT = datetime.timedelta(days=7)
#: A state of several values needs RocksDB; batches without data would follow each other for ever, as time passes in each.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Parts(StatefulProcessor):
    """The lines of a video that comes in parts: they are kept until all are there, then they go on together, and the state is empty.

    Of two deliveries of a part the later counts. Lines with another number of parts than those kept begin anew. ``wait``
    milliseconds after the last line came, what is there goes on with a reason, so no state stays for ever. Lines are rows: a
    data frame for each video would cost more than all else.
    """

    line = Row("file", "line", "video_id", "part", "parts", "reason", "at")

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("parts", "part int", _LINE.replace("timestamp", "long"))

    def _own(self, line: tuple) -> Row:
        """A line as it came, or as it was kept, where ``at`` may be of another type."""
        at = line[6]
        return self.line(*line[:6], tuple(at.values()) if isinstance(at, dict) else tuple(at))

    @staticmethod
    def order(line: Row) -> tuple:
        return (*line["at"], line["line"])

    def _go_on(self, lines: dict[int, Row], reason: str | None) -> Iterator[Row]:
        for _, r in sorted(lines.items()):
            yield self.line(*r[:5], reason, dict(zip(("modified", "file", "n"), r["at"], strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = {k[0]: self._own(v) for k, v in self.kept.iterator()}
        got = dict(old)
        for r in sorted(map(self._own, rows), key=self.order):
            if any(o["parts"] != r["parts"] for o in got.values()):
                got = {}
            if r["part"] not in got or self.order(got[r["part"]]) <= self.order(r):
                got[r["part"]] = r
        whole = len(got) == next(iter(got.values()))["parts"]
        if old:  # a state has a timer, and only a state has one
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if whole or any(k not in got for k in old):
                self.kept.clear()
                old = {}
        if whole:
            yield from self._go_on(got, None)
            return
        for k, r in got.items():
            if old.get(k) is not r:
                self.kept.updateValue((k,), tuple(r))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        got = {k[0]: self._own(v) for k, v in self.kept.iterator()}
        self.kept.clear()
        yield from self._go_on(got, "parts are missing")

    def close(self) -> None:
        pass


def whole_videos(lines: DataFrame, wait: datetime.timedelta = WAIT) -> DataFrame:
    """A stream of told-apart lines with ``at``, those of videos in parts held back in a state per video until all are there; only these pass through the state.

    A video whose parts don't all come within ``wait`` gives its lines a reason.
    """
    lines = lines.select("file", "line", "video_id", "part", "parts", "reason", "at")
    # a key is written out, or with escapes; a line without either has no parts, and is not read once more to tell that
    may = F.col("line").contains('"parts"') | F.col("line").contains("\\u")
    is_part = may & F.col("reason").isNull() & (F.col("parts") > 1)
    at = lambda moment: F.struct(moment("at.modified").alias("modified"), "at.file", "at.n")
    parts = lines.filter(is_part).withColumn("at", at(F.unix_micros)).groupBy("video_id")  # whole numbers, as moments of rows and of the state may differ in their zones
    held = parts.transformWithState(Parts(int(wait.total_seconds() * 1000)), _LINE.replace("timestamp", "long"), "append", "processingTime")
    return lines.filter(~is_part).unionByName(held.withColumn("at", at(F.timestamp_micros)))


def _deliveries(batch: DataFrame) -> DataFrame:
    """The lines of a batch: given whole as (video_id, raw), or told apart."""
    if "line" in batch.columns:
        return batch
    return batch.select(
        F.lit("").alias("file"), F.col("raw").alias("line"), "video_id", F.lit(0).alias("part"), F.lit(1).alias("parts"),
        F.when(F.col("video_id").isNull(), "no video_id").alias("reason"),
        F.struct(F.timestamp_seconds(F.lit(0)).alias("modified"), F.lit("").alias("file"), F.monotonically_increasing_id().alias("n")).alias("at"),
    )


def _latest(lines: DataFrame) -> DataFrame:
    """``lines`` with ``reason`` for those that don't count: of the deliveries of a video the latest counts, if all its parts are there."""
    by = Window.partitionBy("video_id")
    one = lines.withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "parts", "part").orderBy(F.desc("at"), F.desc("line"))))
    one = one.withColumn("_parts", F.max_by("parts", "at").over(by)).withColumn("_last", (F.col("_n") == 1) & (F.col("parts") == F.col("_parts")))
    there = F.count(F.when(F.col("_last"), 1)).over(by)
    reason = F.when(~F.col("_last"), "delivered again").when(there < F.col("parts"), "parts are missing")
    return one.withColumn("reason", reason).drop("_n", "_parts", "_last")


def _uneven(lines: DataFrame) -> DataFrame:
    """The videos not each part of which is there, and there once. Only keys are shuffled."""
    n = lines.groupBy("video_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("own"), F.min("parts").alias("least"), F.max("parts").alias("most"))
    return n.filter("n <> most OR own <> most OR least <> most").select("video_id")


def index_batch(batch: DataFrame, folder: str, embedder=None, batch_id: int = 0, stream: str = "batch", refresh: bool = False, buckets: int | None = None) -> None:
    """One batch of (video_id, raw), or of told-apart lines, into videos, transcripts, segments and chunks; lines that can't be read into quarantine.

    Videos that are ready are passed over, but with ``refresh``. A video with a chunk becomes ready, another failed (it is
    taken up again when it arrives again). An older summary and the time of creation stay. ``videos`` is written last, so a
    batch that breaks off is done again. ``stream`` and ``batch_id`` name what is logged; ``buckets`` is the layout of
    tables that are new. All tables on the way are deleted. Where every line counts, none is shuffled or written once more to tell that.
    """
    spark, name = batch.sparkSession, f"{stream}-{batch_id}"
    with Scratch(spark) as scratch, Scratch(spark, publishing(folder)) as log:
        with Scratch(spark) as own:  # lines are deleted when segments are there
            lines = own(_deliveries(batch))
            good, bad, some = lines.filter("reason IS NULL"), tables.quarantined(lines), False
            if not refresh and tables.exists(spark, folder, "videos"):
                ready = tables.load_for_videos(spark, folder, "videos", good).filter(F.col("status") == P.READY)
                some = not ready.select("video_id").join(good.select("video_id"), "video_id", "left_semi").isEmpty()
                good = index.videos_to_process(good, ready) if some else good
            if some or not _uneven(good).isEmpty():
                good = own(_latest(good))
                bad = bad.unionByName(tables.quarantined(good))
            if not bad.isEmpty():
                publish(bad, folder, "quarantine", name)
            rows = good.filter("reason IS NULL").select("video_id", "part", "parts", F.col("line").alias("raw"))
            if rows.isEmpty():
                return
            field = {c: F.get_json_object("raw", f"$.{c}") for c in _FIELDS}
            about = scratch(rows.groupBy("video_id").agg(*[F.min_by(v, F.when(v.isNotNull(), F.col("part"))).alias(c) for c, v in field.items()]))
            in_parts = rows.filter("parts > 1")
            if not in_parts.isEmpty():  # a video's lines come together, in order; others stand where they are
                rows = rows.filter("parts = 1").unionByName(in_parts.repartition("video_id").sortWithinPartitions("video_id", "part"))
            arrived = log.aside(long_videos.clean_lines(tables.explode_segments(rows)))
        _store(scratch, arrived, about, folder, embedder, name, buckets)


def _transcripts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per video of its segments' texts and of what its lines tell, for save_table."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seg_idx", "text"))))
    text = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: x["text"]), " "))
    return rows.groupBy(*keys).agg(F.max("language").alias("language"), F.max("end").alias("duration"), text.alias("full_text")).filter("full_text IS NOT NULL")


def _store(scratch: Scratch, arrived: Aside, about: DataFrame, folder: str, embedder, name: str, buckets: int | None) -> None:
    """The tables of a batch's videos (``about``: a row of each) and their cleaned segments, which stand aside and are published when the other tables are made of them."""
    spark, clean, ids = about.sparkSession, arrived.rows, about.select("video_id")
    put = lambda df, table, whole=None: tables.replace_buckets(df, folder, table, ids, scratch, buckets, None, whole)
    # chunks are dealt out by blocks of videos already, and not once more for the model
    put(models.embed_column(long_videos.chunk_segments(clean), "text", embedder), "chunks")
    put(clean, "segments")
    put(clean.select("video_id", "seg_idx", "end", "text").unionByName(about.select("video_id", "language"), allowMissingColumns=True), "transcripts", _transcripts)
    publish(arrived, folder, "arrived", name)
    incoming = about.withColumn("updated_at", F.current_timestamp())
    old = tables.load_for_videos(spark, folder, "videos", ids) if tables.exists(spark, folder, "videos") else spark.createDataFrame([], tables.SCHEMAS["videos"])
    chunks = tables.load_for_videos(spark, folder, "chunks", ids).join(ids, "video_id", "left_semi")
    done = tables.upsert_videos(old.join(ids, "video_id", "left_semi"), incoming).join(chunks.select("video_id", F.lit(True).alias("_has")).distinct(), "video_id", "left")
    put(done.withColumn("status", F.when(F.col("_has"), P.READY).otherwise(P.FAILED)), "videos")


def question_batch(batch: DataFrame, folder: str, generator=None, embedder=None, buckets: int | None = None) -> None:
    """Questions of the batch's segments, in place of those stored for its videos; if that fails, they have none, and the failure is stored.

    Segments that are there twice count once; only where there are any are the segments shuffled and written for that.
    """
    spark = batch.sparkSession
    with Scratch(spark) as scratch:
        if not batch.groupBy("video_id", "seg_idx").count().filter("count > 1").isEmpty():
            batch = scratch(batch.dropDuplicates(["video_id", "seg_idx"]))
        ids = scratch(batch.select("video_id").distinct())
        put = lambda df: tables.replace_buckets(df, folder, "questions", ids, scratch, buckets)
        try:
            put(flows.mine_questions(batch, generator, embedder, scratch, long_videos.BLOCK))
        except Exception as e:  # whatever the user's model does, later batches go on
            put(spark.createDataFrame([], tables.SCHEMAS["questions"]))
            rows = ids.withColumn("error", F.lit(f"{type(e).__name__}: {str(e)[:500]}"))
            rows.write.mode("append").parquet(f"{folder}/question_failures")


def stream_index(spark: SparkSession, source: str, folder: str, checkpoint: str, embedder=None, refresh: bool = False, buckets: int | None = None, wait: datetime.timedelta = WAIT):
    """Starts a query that indexes what is in ``source`` (JSON lines with video_id, segments and metadata) and then ends.

    What it logs is named by the query's id, which its checkpoint keeps, and the batch's number.
    """
    _shared(spark, checkpoint)
    text = spark.readStream.text(source)
    at = F.struct(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("n"))
    lines = tables.told_apart(text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), at.alias("at")))

    def run(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        index_batch(batch, folder, embedder, n, own, refresh, buckets)

    with settings(spark, _SETTINGS | FREES_SHUFFLES):  # a query takes its settings when it starts
        return whole_videos(lines, wait).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_questions(spark: SparkSession, folder: str, checkpoint: str, generator=None, embedder=None, buckets: int | None = None):
    """Starts a query over the segments that streams logged; each is mined once, whatever else the tables get."""
    _shared(spark, checkpoint)
    files = spark.readStream.schema(ARRIVED).option("recursiveFileLookup", "true").parquet(f"{folder}/arrived")
    with settings(spark, FREES_SHUFFLES):
        return (
            files.writeStream.foreachBatch(lambda df, _: question_batch(df, folder, generator, embedder, buckets))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _shared(spark: SparkSession, checkpoint: str) -> None:
    """What batches write goes to the session's folder, or beside the stream's own where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(checkpoint, "batches"))
