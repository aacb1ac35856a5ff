"""Reading summaries: the same as a plain mending character by character, in linear time, by either of two ways."""

import json
import random
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transcript_jobs.functions import summary_json as J


def plain_mend(text, inner_quotes, brackets):
    """What _mend does, a character at a time."""
    pairs, out, waiting, quoted, i = {"{": "}", "[": "]"}, [], [], False, 0
    while i < len(text):
        c, i = text[i], i + 1
        if quoted and c == "\\":
            if i < len(text) and text[i] in '"\\/bfnrtu':
                out.append(c + text[i])
                i += 1
            continue
        if c == '"':
            if quoted and inner_quotes and text[i:].lstrip()[:1] not in ("", ",", "]", "}", ":"):
                out.append('\\"')
                continue
            quoted = not quoted
        elif not quoted and brackets and c in pairs:
            waiting.append(pairs[c])
        elif not quoted and brackets and c in "}]":
            if c not in waiting:
                continue
            while waiting[-1] != c:
                out.append(waiting.pop())
            waiting.pop()
        out.append(c)
    body = "".join(out) + '"' * (quoted and brackets)
    if brackets:
        body = (body.rstrip()[:-1] if body.rstrip().endswith(",") else body) + "".join(reversed(waiting))
    return body


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from('"\\{}[],: \nxu é'), max_size=40))
@example('"a" b "c", ')
def test_mend(text):
    for inner in (False, True):
        for brackets in (False, True):
            assert J._mend(text, inner, brackets) == plain_mend(text, inner, brackets)


LINES = '{{"summary_lines": [{}], "main_topics": ["a", " b ", ""], "key_points": [], "conclusions": ["c"]}}'


@pytest.mark.parametrize(
    "text",
    [
        LINES.format(", ".join('"a line of the summary, of some length"' for _ in range(17_000))),
        LINES.format(", ".join('"a "line" of the summary, of some length"' for _ in range(15_000))),
        LINES.format(", ".join('"a line\\_of the summary of some length"' for _ in range(16_000)))[:-40],
        '{"summary_lines": [' + '"' * 640_000,
        "{" * 640_000,
        "[}" * 320_000,
        '"' + " " * 320_000 + '"' * 320_000,
        "{" + ", " * 320_000,
        "```" * 210_000,
        "\\" * 640_000,
    ],
)
def test_linear_time(text):
    """640 KB of a summary take less than a second, and nothing takes long."""
    began = time.time()
    J.parse_one(text)
    assert time.time() - began < (1 if text.startswith('{"summary_lines": ["a') else 5)


def outputs():
    rng, out = random.Random(5), []
    good = {"summary_lines": ["One.", " two  ", ""], "main_topics": ["a", "  "], "key_points": [], "conclusions": ["c"]}
    out += [json.dumps(good), json.dumps(good, indent=1), f"```json\n{json.dumps(good)}\n```", f"Sure: {json.dumps(good)} That's it.", json.dumps(good)[:-9]]
    out += [json.dumps(good | {k: v}) for k in good for v in ([], None, 7, "text", [1, None, "x"], {"a": 1}, ["", " "], True, [["x"]])]
    out += [json.dumps(good | {"summary_lines": [], "summary": s}) for s in ("plain \n", "", 7, None, ["x"])]
    out += [json.dumps({"summary": "s", "other": {"summary": 7, "summary_lines": ["x"]}}), '{"summary": "a", "summary": "b"}', '{"summary": "```json {} ```"}', "[1]", "7", "null", "", None, "prose"]
    out += ['{"summary": "half \\ud83d of one"}', '{"summary": "whole \\ud83d\\ude00"}', '{"summary": "nul \\u0000 x"}', '{"summary": NaN}', '{"summary": "raw\nline\ttab"}', '{"summary": "é😀"}', ' {"summary": "x"} ']
    for _ in range(300):
        t = json.dumps(good | {"summary": "s"})
        i = rng.randrange(len(t))
        out.append(t[:i] + rng.choice(["", '"', "\\", "}", "]", "\n", "```"]) + t[i + rng.randint(0, 2) :])
    return out


def test_both_ways_agree(spark):
    """What Spark's own parser reads is what the mending reads; all the rest is mended."""
    rows = list(enumerate(outputs()))
    df = spark.createDataFrame(rows, "n int, raw string")
    got = df.select("n", J.parse_summary(F.col("raw")).alias("p"), J.final_summary(F.col("raw")).alias("f"), J._sound(F.col("raw")).isNotNull().alias("sound")).collect()
    for r in got:
        want, raw = J.parse_one(rows[r["n"]][1]), rows[r["n"]][1]
        assert (r["p"].asDict() if r["p"] else None) == want, raw
        f = r["f"]
        if want:
            assert {k: f[k] for k in want} == want and f["raw_output"] is None
        else:
            lines = J.salvage_one(raw)
            assert (f["summary"], f["raw_output"]) == (("\n".join(lines), None) if lines else (raw, raw)) and [f[k] for k in J.LISTS] == [[]] * 3 or raw is None
    assert sum(r["sound"] for r in got) >= 20


def test_sound_rows_need_no_python(spark):
    """All that Python gets of rows that Spark's parser reads is a null."""
    rows = spark.createDataFrame([(json.dumps({"summary": f"s{i}", "main_topics": ["é"]}),) for i in range(20)], "raw string")
    assert rows.filter(J._sound(F.col("raw")).isNull()).count() == 0
