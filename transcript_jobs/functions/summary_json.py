"""Tolerant reading of a model's summary JSON: sound JSON by Spark's own parser, the rest mended in Python, in linear time.

The functions in Python are plain ones, not on Arrow: they get a hundred outputs at a time, not ten thousand, so what a
worker holds doesn't grow with the rows of a split.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from transcript_jobs.functions.text import strip

LISTS = ("main_topics", "key_points", "conclusions")
SUMMARY = "summary string, main_topics array<string>, key_points array<string>, conclusions array<string>"
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_PAIRS = {"{": "}", "[": "]"}
#: All that a mending without and with brackets looks at; what lies between is copied as it is.
_MARKS = {False: re.compile(r'["\\]'), True: re.compile(r'["\\{}\[\]]')}
_SPACE = re.compile(r"\s*")
_ESCAPES = frozenset('"\\/bfnrtu')
_AFTER_STRING = frozenset(",]}:")


def _mend(text: str, inner_quotes: bool, brackets: bool) -> str:
    """The text with invalid escapes dropped, quotes within strings escaped (if ``inner_quotes``) and brackets closed (if ``brackets``).

    A quote ends a string only before ``,``, ``]``, ``}``, ``:`` or the end of the text, if ``inner_quotes``. One walk from mark
    to mark; blanks after a quote are looked at once, closers that are due are counted, so it takes linear time.
    """
    out: list[str] = []
    waiting: list[str] = []  # closers that are still due
    due: Counter[str] = Counter()
    quoted, copied, after = False, 0, 0  # copied: up to where the text is in out; after: up to where marks are dealt with
    for m in _MARKS[brackets].finditer(text):
        i, c = m.start(), m[0]
        if i < after:
            continue
        if c == "\\":
            if quoted and text[i + 1 : i + 2] in _ESCAPES:
                after = i + 2
            elif quoted:
                out.append(text[copied:i])
                copied = i + 1
        elif c == '"':
            if quoted and inner_quotes:
                follows = text[i + 1 : i + 2]
                if follows.isspace():
                    follows = text[(end := _SPACE.match(text, i + 1).end()) : end + 1]
                if follows and follows not in _AFTER_STRING:
                    out += text[copied:i], '\\"'
                    copied = i + 1
                    continue
            quoted = not quoted
        elif quoted:
            continue
        elif c in _PAIRS:
            waiting.append(_PAIRS[c])
            due[_PAIRS[c]] += 1
        else:
            out.append(text[copied:i])
            copied = i
            if not due[c]:
                copied = i + 1
                continue
            while (top := waiting.pop()) != c:
                out.append(top)
                due[top] -= 1
            due[c] -= 1
    out.append(text[copied:])
    body = "".join(out)
    if brackets:
        body += '"' * quoted
        stripped = body.rstrip()
        body = (stripped[:-1] if stripped.endswith(",") else body) + "".join(reversed(waiting))
    return body


def _read(text: str):
    """The JSON value of a text, mended as little as possible; None if nothing helps."""
    tried = None
    for mend in (None, (False, False), (False, True), (True, False), (True, True)):
        body = text if mend is None else _mend(text, *mend)
        if body == tried:
            continue
        try:
            return json.loads(body, strict=False)
        except (ValueError, RecursionError):
            tried = body
    return None


def _plain(text: str) -> str:
    """Without halves of surrogate pairs, which no text column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _strings(value) -> list[str]:
    return [_plain(s) for s in (str(x).strip() for x in value) if s] if isinstance(value, list) else []


def parse_one(raw: str | None) -> dict | None:
    """summary, main_topics, key_points and conclusions of one output, or None."""
    if not raw:
        return None
    texts = [raw.strip()]
    if fenced := _FENCE.search(raw):
        texts.insert(0, fenced[1].strip())
    for t in texts:
        value = _read(t)
        if value is None and "{" in t:
            opened = t[t.index("{") :]
            for part in dict.fromkeys((opened[: opened.rfind("}") + 1], opened)):
                if value is None and part and part != t:
                    value = _read(part)
        if not isinstance(value, dict):
            continue
        lines = _strings(value.get("summary_lines"))
        summary = "\n".join(lines) if lines else value.get("summary")
        if isinstance(summary, str) and summary.strip():
            return {"summary": _plain(summary.strip())} | {k: _strings(value.get(k)) for k in LISTS}
    return None


def salvage_one(raw: str | None) -> list[str] | None:
    """The quoted rows after the row with "summary_lines", up to a row that begins with ] or names a key."""
    rows = [r.strip() for r in (raw or "").splitlines()]
    start = next((i for i, r in enumerate(rows) if '"summary_lines"' in r), len(rows))
    found = []
    for r in rows[start + 1 :]:
        if r.startswith("]") or re.match(r'"\w+"\s*:', r):
            break
        if (m := re.fullmatch(r'"(.*)"\s*,?', r)) and m[1].strip():
            found.append(m[1].replace('\\"', '"').strip())
    return found or None


def _sound(raw: Column) -> Column:
    """The parsed struct where the output is plain sound JSON with a summary, texts and lists of texts alone; NULL for all others.

    These give the same by either way, and need no Python: no fence, no key twice, no halves of characters, nothing that
    Spark's parser refuses.
    """
    kinds = F.schema_of_variant(F.try_parse_json(raw))
    odd = r"(^|\W)((summary_lines|main_topics|key_points|conclusions): (?!ARRAY<(STRING|VOID)>)|summary: (?!STRING))"
    plain = kinds.startswith("OBJECT<") & ~kinds.rlike(odd) & ~raw.contains("```") & ~raw.rlike(r"(?i)\\u(d[89a-f]|0000)")
    got = F.try_variant_get(F.try_parse_json(raw), "$", f"struct<summary_lines: array<string>, {SUMMARY}>")
    none = F.array().cast("array<string>")
    whole = lambda c: ~F.exists(F.coalesce(c, none), lambda x: x.isNull())
    texts = lambda c: F.filter(F.transform(F.coalesce(c, none), strip), lambda x: x != "")

    def made(g: Column) -> Column:
        lines = texts(g["summary_lines"])
        summary = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(strip(g["summary"]))
        fits = whole(g["summary_lines"]) & whole(g["main_topics"]) & whole(g["key_points"]) & whole(g["conclusions"]) & (summary != "")
        return F.when(fits, F.struct(summary.alias("summary"), *[texts(g[k]).alias(k) for k in LISTS]))

    return F.when(plain, F.get(F.transform(F.array(got), made), F.lit(0)))  # got is made once, for all that is made of it


def parse_summary(c: Column) -> Column:
    """Struct of the parsed summary; NULL where none can be read."""
    sound = _sound(c)
    return F.coalesce(sound, F.udf(parse_one, SUMMARY, useArrow=False)(F.when(sound.isNull(), c)))


def salvage_lines(c: Column) -> Column:
    """The rows of summary_lines where the whole can't be parsed; NULL if there are none."""
    return F.udf(salvage_one, "array<string>", useArrow=False)(c)


def final_summary(raw: Column) -> Column:
    """struct(summary, lists, raw_output): parsed, else the salvaged rows, else the raw output itself. One pass over what isn't sound."""

    def last(x: str | None) -> dict:
        if x is None:
            return dict.fromkeys(LISTS, [])
        if got := parse_one(x):
            return got
        lines = salvage_one(x)
        return dict.fromkeys(LISTS, []) | ({"summary": "\n".join(lines)} if lines else {"summary": x, "raw_output": x})

    mended = F.udf(last, f"{SUMMARY}, raw_output string", useArrow=False)
    sound = _sound(raw)
    rest = mended(F.when(sound.isNull(), raw))
    return F.when(sound.isNotNull(), sound.withField("raw_output", F.lit(None).cast("string"))).otherwise(rest)
