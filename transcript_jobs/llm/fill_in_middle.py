"""Fill-in-the-middle texts: cuts at word boundaries found in arrays of code points, parts in another order, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import Aside, table, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100: texts that are left plain, and of the others those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from the sha256 of ``seed:key``; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of an array of code points end, after a 0: entry k is the code points in the first k tokens."""
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122) & (points < 128)
    ends = np.ones(len(points) + 1, bool)
    ends[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(ends) if len(points) else np.zeros(1, np.int64)


def parts(text: str, first: int, second: int) -> tuple[int, str, str, str]:
    """(tokens, prefix, middle, suffix): cut after ``first`` and ``second`` tokens, modulo one more than there are, in rising order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    a, b = sorted((first % (n + 1), second % (n + 1)))
    piece = lambda x, y: points[x:y].tobytes().decode("utf-32-le")
    return n, piece(0, at[a]), piece(at[a], at[b]), piece(at[b], len(points))


def arrange(text: str, h1: int, h2: int, h3: int, h4: int, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text by its four draws."""
    n, prefix, middle, suffix = parts(text, h1, h2)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; columns of docs with these names, in any case, give way to them.

    Each row is cut for itself, where it is read: rows of one key are cut by the same draws, and repeated rows alike.
    A null text is the empty one, which is plain, as are texts with a marker in them; plain rows have no prefix_chars and
    middle_chars, and their output is the text. Very long texts take four bytes a code point for the time of their cut.
    """
    own = Aside(docs)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            got = [arrange(*row, plain_percent, spm_percent) for row in zip(*(c.tolist() for c in columns), strict=True)]
            rows = pd.DataFrame(got, columns=list(MADE))
            yield rows.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = own.df.withColumn("_cut", cut(text_or_empty(own(text)), *draws(own(key), seed)))
    return rows.select(*own.back(without=MADE), *[F.col("_cut")[c].alias(c) for c in MADE])


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: its parts, told apart by the markers, in their first order. No text with a marker is ever cut."""

    def between(head: str, mark: str) -> tuple[Column, Column, Column]:
        """What stands between ``head`` and ``mark``, from there to MIDDLE, and after it."""
        rest = F.substr(output, F.lit(len(head) + 1))
        first = F.split(rest, mark, 2)
        last = F.split(F.get(first, F.lit(1)), MIDDLE, 2)
        return F.get(first, F.lit(0)), F.get(last, F.lit(0)), F.get(last, F.lit(1))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_2, prefix_2, middle_2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256")
    )


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id::VARCHAR) AS h FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, len(units) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, array_to_string(units[1:a], '') AS prefix,
         array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""
