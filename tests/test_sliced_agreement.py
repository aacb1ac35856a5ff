"""Agreement of whole transcripts in slices, against brute force."""

from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from conftest import SF

from transcript_jobs import queries
from transcript_jobs.operators import quality


def brute(segments):
    """video -> 2M/T over slices of 600 s of the words, and of those without every 25th."""
    slices, at = defaultdict(lambda: defaultdict(lambda: ([], []))), defaultdict(int)
    for r in sorted(segments, key=lambda r: (r["video_id"], r["seg_idx"])):
        whole, thin = slices[r["video_id"]][int(r["start"] // 600)]
        for w in r["text"].lower().split(" "):
            whole.append(w)
            if at[r["video_id"]] % 25 != 24:
                thin.append(w)
            at[r["video_id"]] += 1
    out = {}
    for v, of in slices.items():
        m = sum(b.size for x, y in of.values() for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        out[v] = 2 * m / sum(len(x) + len(y) for x, y in of.values())
    return out, at, max(len(of) for of in slices.values())


def test_query_rows(spark):
    got = queries.transcript_agreement(spark, SF).collect()
    want, words, most = brute(queries._clean(spark, SF).collect())
    assert len(got) == len(want) and {r["video_id"]: r["agreement"] for r in got} == pytest.approx(want, abs=1e-12)
    assert most > 1 and all((r["agreement"] < 1) == (words[r["video_id"]] >= 25) for r in got)


def test_missing_slices(spark):
    runs = spark.createDataFrame([("v", "r", 0, "a b"), ("v", "r", 2, "e"), ("x", "r", 0, "no baseline")], "video_id string, run string, n int, text string")
    base = spark.createDataFrame([("v", 0, "A c b"), ("v", 1, "d d d"), ("w", 0, "no run")], "video_id string, n int, text string")
    assert [tuple(r) for r in quality.sliced_agreement(runs, base).collect()] == [("v", "r", 2 * 2 / 9)]
