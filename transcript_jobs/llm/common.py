"""What the operators share: reading a table, tables written on the way, a filter by bitmap, a join that spreads hot keys, the word class."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what parts words.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, one is made on a single machine only."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Tables that a job writes to the shared folder and reads again, so that a lost executor costs a read only."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in self.names & set(names):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names -= set(names)

    def keep(self, *names: str) -> None:
        """Deletes all other tables."""
        self.drop(*(self.names - set(names)))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    return Scratch(df.sparkSession, "cut").put(df, "rows")


#: Bits of the bitmap of among: 4 MB in all, whatever it stands for.
BITMAP_BITS = 1 << 25


def _marked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: true for every row whose ``column`` is among ``ids`` (of one column), and for some others.

    It is told by a bitmap with one bit per hash, of BITMAP_BITS at most, in rows of 4 KB; so it may be broadcast
    however many ids there are. It saves the more the fewer there are.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS)) + 1
    key = ids.columns[0]
    bitmap = ids.groupBy(F.bitmap_bucket_number(place(key)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("_bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(place(column))).join(F.broadcast(bitmap), "_bucket", "left")
    return marked.withColumn("_maybe", found).drop("_bucket", "_bits")


def among(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is among the distinct ``ids`` (left_semi), or is not (left_anti); a null is not.

    Only rows that may be among them are shuffled for the exact join.
    """
    marked = _marked(rows, column, ids)
    exact = marked.filter("_maybe").drop("_maybe").join(ids.withColumnRenamed(ids.columns[0], column), column, how).select(*rows.columns)
    return exact if how == "left_semi" else exact.unionByName(marked.filter("NOT _maybe").drop("_maybe"))


#: A key is hot if more than one in so many of all rows have it; so there are fewer hot keys than that, however large the table.
HOT_SHARE = 4096


def hot_keys(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """The hot keys of ``rows``, of which there are ``total``: fewer than HOT_SHARE, so they and a row for each may be broadcast."""
    return rows.groupBy(*by).count().filter(F.col("count") * HOT_SHARE > total).select(*by)


def join_spread(rows: DataFrame, facts: DataFrame, by: list[str], hot: DataFrame) -> DataFrame:
    """Inner join with ``facts``, which has one row for each key of ``rows``: all columns of rows, then the others of facts.

    Rows of hot keys stay where they are and are given their facts by broadcast; only the rest are shuffled by key, so
    no task is sent more of one key than a HOT_SHARE of all rows. Rows with a null in their key are dropped.
    """
    few = facts.join(F.broadcast(hot), by, "left_semi").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(few), by, "left")
    columns = [*rows.columns, *(c for c in facts.columns if c not in by)]
    rest = marked.filter("_hot IS NULL").select(*rows.columns).join(facts, by)
    return marked.filter("_hot").select(*columns).unionByName(rest.select(*columns))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


class Aside:
    """The columns of a table under names of their own, so that none of them clashes with what an operator makes.

    Names are told apart exactly, so ``Score`` beside ``score``, names with dots and repeated names are no trouble.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.df = docs.toDF(*[f"_x{i}" for i in range(len(self.names))])

    def __call__(self, name: str) -> Column:
        """The column that was called ``name``: exactly so, or else but for upper and lower case."""
        return F.col(self.here(name))

    def here(self, name: str) -> str:
        """What the column is called here."""
        same = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"{len(same)} columns are called {name}")
        return f"_x{same[0]}"

    def back(self, without: tuple[str, ...] = (), but: str = "", **instead: Column) -> list[Column]:
        """The columns by their old names, in order, without ``but`` and those called like one of ``without`` in any case; some ``instead``."""
        out = {n.lower() for n in without}
        return [instead.get(n, F.col(f"_x{i}")).alias(n) for i, n in enumerate(self.names) if n.lower() not in out and n != but]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, WHITE_CLASS + "+"), lambda w: w != "")


def md5_unit(*cols: Column) -> Column:
    """A number in (0, 1) from the md5 of the columns as text; the same in every engine and run."""
    first = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13)
    return (F.conv(first, 16, 10).cast("double") + 0.5) / float(2**52)
