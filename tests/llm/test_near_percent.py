"""Near copies between the threshold of op2 (0.85) and that of the pipeline's stage (0.80)."""

import itertools
import random

from transcript_jobs.llm import near_dups


def pairs_at(rng, n_pairs, n_words, changed):
    """Rows (2k, t), (2k + 1, u): u is t with its last ``changed`` words replaced, so the similarity is known."""
    rows, alike = [], []
    for k in range(n_pairs):
        w = [f"w{k}x{rng.randrange(10**6)}" for _ in range(n_words)]
        u = w[: n_words - changed] + [f"v{k}x{i}" for i in range(changed)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(u))]
        same, all_ = n_words - 4 - changed, n_words - 4 + changed
        alike.append(100 * same / all_)
    return rows, alike


def components(spark, rows, **how):
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    return sorted((r["doc_id"], r["component_id"]) for r in got)


def truth(rows, percent):
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    comp = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
            comp = {k: new if c == old else c for k, c in comp.items()}
    return sorted(comp.items())


def test_percent(spark):
    rows, alike = pairs_at(random.Random(3), 40, 104, 11)  # 89 of 111 shingles: 0.8018
    assert all(80 <= x < 81 for x in alike)
    assert components(spark, rows, percent=80) == truth(rows, 80) == [(i, i - i % 2) for i in range(80)]
    assert components(spark, rows) == truth(rows, 85) == [(i, i) for i in range(80)]


def test_percent_in_dense_regions(spark, monkeypatch):
    """A family whose members differ at the end, in small blocks: links of 0.8 are found there too."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(104)]
    t = [" ".join(base[: 104 - (c := rng.choice((4, 5, 6, 11)))] + [f"v{k}x{i}" for i in range(c)]) for k in range(60)]
    rows = list(enumerate(t))
    monkeypatch.setattr(near_dups, "FIRST_TREES", 1)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    for percent in (80, 85):
        assert components(spark, rows, percent=percent) == truth(rows, percent)


def test_pipeline_stage_drops_at_80(spark):
    import corpus_pipeline as C

    rows, _ = pairs_at(random.Random(5), 20, 104, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.dedup(spark, docs, "").collect()) == [2 * k for k in range(20)]


def test_least_equal_loses_less_than_the_forest():
    import math

    for percent in (80, 85):
        p, least = percent / 100, near_dups.least_equal(percent)
        tail = [sum(math.comb(near_dups.HASHES, k) * p**k * (1 - p) ** (near_dups.HASHES - k) for k in range(n)) for n in (least, least + 1)]
        assert tail[0] < (1 - p**near_dups.DEPTH) ** near_dups.TREES <= tail[1]
