"""Texts are looked at once: what is used in several places is computed in one, by the rules of the patterns it was before."""

import itertools
import random

from pyspark.sql import functions as F

from transcript_jobs import params as P
from transcript_jobs.functions import text as T
from transcript_jobs.operators import questions


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_output_is_read_once(spark):
    rows = [("v1", "So what is the river Rhine made of? Water", x) for x in ("Answer: what is the river Rhine made of", '"What is the river Rhine?!"', "What is a castle near the garden?", "None (no)", "", None, " \n")]
    out = questions.accept_questions(spark.createDataFrame(rows, "video_id string, text string, output string"))
    assert plan(out).count("answer|question|response") == 2  # of the whole output and of its first line
    assert out.columns == ["video_id", "text", "question"]
    assert sorted(r["question"] for r in out.collect()) == ["What is the river Rhine made of?", "What is the river Rhine??"]


def test_an_overlap_looks_at_the_question_once(spark):
    df = spark.createDataFrame([("What is the river?", "the river")], "q string, t string")
    assert plan(df.select(T.grounding_overlap(F.col("q"), F.col("t")).alias("o"))).count("regexp_extract_all") == 2


def test_strip_by_letters_is_strip_by_pattern(spark):
    letter = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    df = spark.range(1, 0x11000).filter("id not between 55296 and 57343 and id <> 65279").select(letter.alias("c"))
    df = df.withColumn("t", F.concat("c", F.lit(" "), "c", F.lit("a\n"), "c", F.lit("b "), "c"))
    old = F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert df.filter(T.strip(F.col("t")) != old).count() == 0
    assert df.filter(T.strip(F.col("c")) == "").count() == len(T.BLANKS)


def test_clauses_in_two_patterns(spark):
    draw = random.Random(7)
    parts = [*". ! ? , ; x".split(), " ", " ", " ", " ", " ", "\n", "what", "Why", "İs", "so", "AND", "now ", "island", "é"]
    rows = [("".join(draw.choices(parts, k=draw.randint(1, 9))),) for _ in range(4000)] + [("".join(x),) for x in itertools.product(parts, repeat=2)]
    any_ = lambda words: "(?:" + "|".join(words) + ")"
    old = rf"(?iU)(?:^|[.!?]\s+|,\s*)(?:{any_(P.LEAD_INS)}\s+)?{any_(P.INTERROGATIVES)}\b"
    df, c = spark.createDataFrame(rows, "t string"), F.col("t")
    assert df.filter((c.rlike(T.FIRST_CLAUSE) | c.rlike(T.LATER_CLAUSE)) != c.rlike(old)).count() == 0
    assert 100 < df.filter(c.rlike(T.LATER_CLAUSE)).count() < 4000
