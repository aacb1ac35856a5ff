"""Matching words by runs in arrays, held against difflib."""

import random
from difflib import SequenceMatcher

import pytest

from transcript_jobs.operators import quality


def by_difflib(a: str, b: str) -> tuple[int, int]:
    x, y = a.lower().split(), b.lower().split()
    return sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()), len(x) + len(y)


@pytest.mark.parametrize("words", [1, 2, 5, 40, 1000])
def test_as_difflib_finds_it(words):
    r = random.Random(words)
    for _ in range(150):
        a = [f"W{r.randrange(words)}" for _ in range(r.randrange(60))]
        b = [w.lower() for w in a if r.random() < 0.9] if r.random() < 0.5 else [f"w{r.randrange(words)}" for _ in range(r.randrange(60))]
        r.random() < 0.2 and b.reverse()
        assert quality._matching(" ".join(a), " ".join(b)) == by_difflib(" ".join(a), " ".join(b))
    assert quality._matching(None, "a b") == (0, 2) and quality._matching("", None) == (0, 0)


def test_a_slice_needs_no_walk_in_python(monkeypatch):
    """Texts of a slice's size don't come to difflib; those with more equal pairs than are held do, with the same result."""
    r = random.Random(1)
    a = [f"w{r.randrange(300)}" for _ in range(1200)]
    b = [w for i, w in enumerate(a) if i % 25 != 24]
    want = by_difflib(" ".join(a), " ".join(b))
    with monkeypatch.context() as m:
        m.setattr(quality, "SequenceMatcher", None)
        assert quality._matching(" ".join(a), " ".join(b)) == want
    monkeypatch.setattr(quality, "PAIRS", 10)
    assert quality._matching(" ".join(a), " ".join(b)) == want
