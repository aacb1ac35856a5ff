"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from transcript_jobs.functions import citations as C
from transcript_jobs.functions import summary_json as J
from transcript_jobs.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).head()["r"]


@pytest.mark.parametrize("raw, clean", [("  Hello     everyone.  ", "Hello everyone."), ("Hello\n\n\teveryone.", "Hello everyone."), (None, ""), ("a  b\x1c", "a b")])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


@pytest.mark.parametrize("s, stamp, length", [(5.0, "00:05", "0:05"), (1122.5, "18:42", "18:42"), (3725.0, "1:02:05", "1:02:05"), (-3.2, "00:00", "0:00"), (0.0, "00:00", "Unknown")])
def test_clocks(spark, s, stamp, length):
    assert one(spark, s, T.format_timestamp, "double") == stamp
    assert one(spark, s, T.format_duration, "double") == length


def test_timestamp_url(spark):
    assert one(spark, 1122.5, lambda c: T.timestamp_url(F.lit("abcDEF12345"), c), "double") == "https://www.youtube.com/watch?v=abcDEF12345&t=1122s"


@pytest.mark.parametrize("raw", ["what is overfitting", 'Answer: "What is overfitting?"', "what   is\n\noverfitting", " 'what is overfitting.' "])
def test_normalize_question(spark, raw):
    assert one(spark, raw, T.normalize_question) == "What is overfitting?"


@pytest.mark.parametrize("raw", ["", None, '""'])
def test_normalize_nothing(spark, raw):
    assert one(spark, raw, T.normalize_question) == ""


@pytest.mark.parametrize("s", ["Okay?", "Are you ready?", "Does that make sense?", "Can you hear me?", "so, okay"])
def test_filler(spark, s):
    assert one(spark, s, T.is_pure_filler) and not one(spark, s, T.segment_has_candidate)


@pytest.mark.parametrize("s, flag", [("So what happens when the model overfits", True), ("We know that. Why does it matter", True), ("This is what we do.", False), ("Fine, can we go", True), ("Isérable words here", False), ("A mark? here", True)])
def test_candidates(spark, s, flag):
    assert one(spark, s, T.segment_has_candidate) is flag


@pytest.mark.parametrize("s, follows", [("What about its batteries?", True), ("How do I use it?", True), ("And with the fast one?", True), ("Really?", True), ("What is the capital of France?", False), ("Explain how neural networks are trained.", False)])
def test_follow_up(spark, s, follows):
    assert one(spark, s, T.looks_like_follow_up) is follows


URL = "dQw4w9WgXcQ"


@pytest.mark.parametrize(
    "url, ok",
    [
        (f"https://www.youtube.com/watch?v={URL}", True), (f"https://youtu.be/{URL}?t=3", True), (f"http://m.youtube.com/shorts/{URL}/", True),
        (f"  https://user@music.youtube.com:80/watch/?list=x&v={URL}#a ", True), (f"https://YouTube.com/watch?v=&v={URL}", True),
        (f"https://youtube.com/shorts/{URL}/x", True), (f"youtube.com/watch?v={URL}", False), (f"https://vimeo.com/watch?v={URL}", False),
        ("https://youtube.com/", False), ("https://youtube.com/watch?v=short", False), ("https://youtube.com/@channel", False), ("", False), (None, False),
        (f"ftp://youtube.com/watch?v={URL}", False), (f"https://youtube.com/watch?v={URL}x", False), ("https://youtube.com/playlist?list=a b|c", False),
    ],
)
def test_url(spark, url, ok):
    got = one(spark, url, T.validate_url)
    assert got["valid"] is ok and got["video_id"] == (URL if ok else None) and (got["error"] is None) is ok


@pytest.mark.parametrize(
    "answer, n, clean, cited",
    [
        ("Answer here. Sources: 1, 3.", 3, "Answer here.", [1, 3]),
        ("Answer. (Source: Chunk 2)", 3, "Answer.", [2]),
        ('Use "-ss 10" (Sources: 1, 3). Then run it (Sources: 1).', 5, 'Use "-ss 10". Then run it.', [1, 3]),
        ("Use Homebrew (Sources: 1).\n\nSources:\n1. Chunk 1 (00:00 - 02:52)\n2. Chunk 2 (30:03 - 33:05)", 5, "Use Homebrew.", [1, 2]),
        ("Version (1) shipped in (2020). Sources: wiki pages are mentioned.", 5, "Version (1) shipped in (2020). Sources: wiki pages are mentioned.", []),
        ("It costs 3 dollars.\nSources: 9", 2, "It costs 3 dollars.", []),
        ("Both [Chunk 1] and [chunks 2, 3].\n**Sources: 2 and chunk 1**", 3, "Both and.", [2, 1, 3]),
        (None, 3, "", []),
    ],
)
def test_citations(spark, answer, n, clean, cited):
    got = one(spark, answer, lambda c: C.extract_citations(c, F.lit(n)))
    assert (got["answer"], got["cited"]) == (clean, cited)


def test_grounding(spark):
    pairs = [("What are the benefits of solar panels?", "we talk about cooking pasta", False), ("How does the gradient vanish?", "so how does the gradient vanish in deep nets", True), ("What is it?", "what is it", False)]
    for q, text, ok in pairs:
        got = spark.createDataFrame([(q, text)], "q string, t string").select(T.grounding_overlap(F.col("q"), F.col("t")).alias("r")).head()["r"]
        assert (got >= 0.5) is ok


@pytest.mark.parametrize("text, n", [("a\n\n b \n   \nc", 3), ("", 0), (None, 0)])
def test_lines(spark, text, n):
    assert one(spark, text, T.summary_line_count) == n


GOOD = '{"summary_lines": ["one", "two"], "main_topics": ["a "], "key_points": [""], "conclusions": []}'


@pytest.mark.parametrize(
    "raw",
    [
        GOOD, f"```json\n{GOOD}\n```", f"Here it is: {GOOD} Hope it helps.", GOOD[:-1], GOOD.replace("[]}", "["), GOOD.replace("one", "o\\_ne").replace("o_ne", "one"),
        GOOD[:-2] + "}", GOOD.replace('"one"', '"one\n"'), "Sure. " + GOOD[:-2],
    ],
)
def test_parse(raw):
    got = J.parse_one(raw)
    assert got and got["summary"].replace("_", "").split() == ["one", "two"] and got["main_topics"] == ["a"]


def test_parse_inner_quotes_and_failures():
    assert J.parse_one('{"summary": "run "x" now", "main_topics": []}')["summary"] == 'run "x" now'
    assert J.parse_one("no json") is None and J.parse_one(None) is None and J.parse_one('{"summary": " "}') is None and J.parse_one("[1]") is None


def test_salvage():
    raw = '{\n"summary_lines": [\n"a b",\n"c \\"d\\"",\n"e"\n],\nmain: ["x"]}'
    assert J.salvage_one(raw) == ["a b", 'c "d"', "e"]
    assert J.salvage_one('{"summary_lines": []}') is None and J.salvage_one(None) is None


def test_final_summary(spark):
    got = one(spark, "plain words", J.final_summary)
    assert got["summary"] == got["raw_output"] == "plain words" and got["main_topics"] == []
    assert one(spark, GOOD, J.final_summary)["raw_output"] is None


def test_rewrite(spark):
    f = lambda text, n=2, follows=True: one(spark, text, lambda c: C.accept_rewrite(F.lit("q"), c, F.lit(n), F.lit(follows)))
    assert f('"What is x?"\nmore') == "What is x?"
    assert f("") == f(None) == f("x" * 301) == f("new", 0) == f("new", 2, False) == "q"


def test_capital_is_one_letter(spark, duck):
    """Every code point's capital, as SQL has it; ß is not spelled out."""
    every = [chr(i) for i in range(1, 0x1E944) if not 0xD800 <= i <= 0xDFFF and chr(i).isalpha()]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", T.capital(F.col("x"))).collect()}
    want = duck.sql("SELECT chr(i::INT) AS x, upper(chr(i::INT)) AS y FROM range(1, 125252) t(i) WHERE NOT i BETWEEN 55296 AND 57343").fetchall()
    assert {x: y for x, y in want if len(x.upper()) > 1 and x.isalpha()} == {x: y for x, y in got.items() if len(x.upper()) > 1}
    rows = spark.createDataFrame([("ßungber ist das",), ("über was",), ("ŉ so",)], "q string")
    assert [r[0] for r in rows.select(T.normalize_question(F.col("q"))).collect()] == ["ẞungber ist das?", "Über was?", "ŉ so?"]
