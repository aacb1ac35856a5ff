"""Fill-in-the-middle against plain regular expressions, and back again."""

import hashlib
import re

from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transcript_jobs.llm import fill_in_middle as M

TEXTS = [
    None, "", " ", "one", "two words", "a<P>b", "<S>", "<M", "P><S", "über-straße 12\nñandú\r\n\x00end", "😀😀 x\U0010ffff", "é‍", "[`{@^AZaz", "a b",
    "don't stop. " * 4000, "x" * 100_000, " " * 50_000, "語" * 999, "KKſ",
]


def brute(key, text, seed=1, plain=10, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts_and_back(spark):
    rows = [(k, t) for t in TEXTS for k in (None, 0, 7, 7, 12345678901, -4, *range(20, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("N", "form", "_cut", "_x0", "output", "a.dot", "TEXT")])
    out = M.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "_cut", "_x0", "a.dot", "TEXT", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = out.toDF("doc_id", "text", "c", "x", "d", "other", *M.MADE).withColumn("back", M.restore(F.col("output"), F.col("form")))
    got = out.select("doc_id", "text", *M.MADE, "back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:7]) == brute(r[0], r[1]), (r[0], r[1] and r[1][:30])
        assert r["back"] == (r[1] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_shares_are_parameters(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "'some words here' AS text")
    forms = lambda **p: {r["form"]: r["count"] for r in M.fill_in_middle(df, **p).groupBy("form").count().collect()}
    assert forms(plain_percent=100) == {"plain": 400} and forms(plain_percent=0, spm_percent=0) == {"psm": 400}
    assert 40 < forms(seed=2, plain_percent=0)["spm"] < 130


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = M.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        n, form, prefix, middle, output = brute(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, prefix, middle, sha(output))
        assert r["restored_sha256"] == sha(docs[r["doc_id"]] or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ<>PSM 1é😀\n")), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_parts_join_again(text, a, b):
    n, *three = M.parts(text, a, b)
    assert "".join(three) == text and n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
