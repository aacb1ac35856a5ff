"""Results that are computed once: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Texts are most of what is written, and zstd takes fewer bytes for them than Spark's default.
CODEC = "zstd"
#: Shuffle files go when the job that made them ends, not when the driver happens to collect its garbage.
FREES_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The session's settings ``own``, for a while."""
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the setting is missing, a folder is made on a single machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Aside(NamedTuple):
    """A written table and the folder of its files; publish moves the files, and the rows can't be read after that."""

    rows: DataFrame
    path: str


class Scratch:
    """Tables of one piece of work: written once, read as often as needed, deleted at its end.

    with Scratch(spark) as scratch: rows = scratch(rows)
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder, self.n = spark, f"{folder or shared_dir(spark)}/written-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` as a table: what a model made is made once, and a lost executor costs a read."""
        return self.aside(df).rows

    def aside(self, df: DataFrame) -> Aside:
        """``df`` as a table that can be published."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path, compression=CODEC)
        return Aside(self.spark.read.schema(df.schema).parquet(path), path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        files, path = file_system(self.spark, self.folder)
        files.delete(path, True)


def written(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``df`` as a table of ``scratch``; without one, as a table that stays for whoever reads what is made of it."""
    return (scratch or Scratch(df.sparkSession))(df)


def publishing(folder: str) -> str:
    """Where the files stand that are to be published in ``folder``: on its file system, as they are renamed."""
    return f"{folder}/_publishing"


def publish(df: DataFrame | Aside, folder: str, name: str, key: str) -> None:
    """``df`` as files in ``folder/name/key``, all of them at once: they are written aside, and their folder is renamed.

    What is published is never written again: a key that is there already stays as it is, so a batch that is done
    anew publishes nothing twice. A table that stands aside already (a Scratch in ``publishing(folder)``) is not written once more.
    """
    spark = df.rows.sparkSession if isinstance(df, Aside) else df.sparkSession
    files, target = file_system(spark, f"{folder}/{name}/{key}")
    if files.exists(target):
        return
    with Scratch(spark, publishing(folder)) as scratch:
        aside = df if isinstance(df, Aside) else scratch.aside(df)
        files.mkdirs(target.getParent())
        if files.exists(target):  # a rename would move it into that
            return
        if not files.rename(file_system(spark, aside.path)[1], target) and not files.exists(target):
            raise OSError(f"{target} could not be published")
