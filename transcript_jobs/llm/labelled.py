"""Labelled rows for the classifiers: what may be learned from, in a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether labels of this key are never learned from: crc32 of the key as text leaves 1 by 3. A null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def sample(labels: DataFrame, label: str, rows: int, key: str = "doc_id") -> DataFrame:
    """(key, y): at most ``rows`` keys with a label of 0 or 1 that aren't held out, chosen by hash, the same in every run.

    A key that is labelled twice counts once, with the larger label.
    """
    y = F.col(label).cast("int")
    return (
        labels.filter(y.isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias(key))
        .agg(F.max(y).alias("y"))
        .orderBy(F.xxhash64(key, F.lit(5)), key)
        .limit(rows)
    )
