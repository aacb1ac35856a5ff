"""MinHash near-duplicates by an LSH forest.

Each tree orders the documents' signatures by its own run of hash values. Documents whose longest common prefix
reaches the least depth lie in one region of a tree. A region's entries stand in the order of longer prefixes;
where it is dense, the prefix grows by a hash value at a time until the part that shares it is small enough.

First, in FIRST_TREES trees, the neighbours within such parts are candidates: each part gives the pairs of a
spanning forest of its alike signatures, not all its pairs. Then, in all trees, a region that still holds more than
one component is gone through to the end: entries outside its largest component against all its entries, in blocks
of bounded size, by signatures; what they leave is compared on full sets, again in blocks. Every link is confirmed
on full sets. So no pair within a region is left out, and a link is lost only if its documents share no region of
any tree, (1 - 0.85 ** 4) ** 24 = 2e-8 at a threshold of 85 percent and 3e-6 at one of 80, less above, or if too few
of their hash values agree (see least_equal).

What crosses the network is narrow: an entry is its place and id; signatures follow where a region has company, and
sets where signatures agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import HOT_SHARE, Scratch, among, hot_keys, join_spread, table, text_or_empty

SHINGLE = 5
#: A pair is linked if 100 * |intersection| >= percent * |union|; PERCENT is that of op2.
PERCENT = 85
TREES, DEPTH = 24, 4
HASHES = TREES * DEPTH
#: Trees of the neighbours; entries of a part whose prefix need not grow.
FIRST_TREES, PART = 4, 512
#: Entries and shingles of a block; pairs of signatures that a task compares at once.
BLOCK, BLOCK_SHINGLES, PAIRS_AT_ONCE = 2048, 1_000_000, 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x100000001B3)
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def least_equal(percent: int) -> int:
    """Equal hash values that a pair must have to be confirmed: fewer are less likely, at percent, than that the forest misses the pair."""
    p, tail, k = percent / 100, 0.0, 0
    while k < HASHES and (tail := tail + math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)) < (1 - p**DEPTH) ** TREES:
        k += 1
    return k


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in order."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64)
    white = _KIND[raw]
    edge = np.diff(white, prepend=np.uint8(1), append=np.uint8(1)).view(np.int8)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = white == 0
    order = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = _powers(int(sizes.max()))
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers[order]
    return _scramble(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


_KNOWN_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _KNOWN_POWERS
    if len(_KNOWN_POWERS) < n:
        _KNOWN_POWERS = np.cumprod(np.append(np.uint64(1), np.full(2 * n, _POWER, np.uint64)), dtype=np.uint64)
    return _KNOWN_POWERS


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's 5-word shingles, rising; of all its words if there are fewer; of none if it has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = _scramble(h * _MIX + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES 16-bit minimum hashes of a shingle set."""
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    parts = [(x[at : at + 512] * _A + _B).min(axis=0) for at in range(0, len(x), 512)]  # a part stays in the cache
    return (_scramble(np.min(parts, axis=0).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, k1, k2, sig) per row: number of shingles, two numbers that tell the set, the signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["t"]]
            yield pd.DataFrame(
                {
                    "id": b["id"].astype("Int64"),
                    "n": [len(s) for s in sets],
                    "k1": [told(s) for s in sets],
                    "k2": [told(_scramble(s)) for s in sets],
                    "sig": [signature(s).tobytes() if len(s) else b"" for s in sets],
                }
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.mapInPandas(run, "id long, n long, k1 long, k2 long, sig binary")


def told(s: np.ndarray) -> int:
    """A 64-bit number that tells a set of hashes."""
    return int(np.add.reduce(s, dtype=np.uint64).view(np.int64))


def _trees(reps: DataFrame) -> DataFrame:
    """(tree, region, deeper, id, v, n): an entry per tree; region is the prefix of the least depth, deeper the DEPTH hash values after it.

    Both are big-endian numbers, so their order is that of the hash values, the first of them first.
    """
    places = (np.arange(TREES)[:, None] * DEPTH + np.arange(2 * DEPTH)[None, :]) % HASHES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), HASHES)
            keys = np.ascontiguousarray(sig[:, places].astype(">u2")).view(">i8").astype(np.int64)
            rows = {"tree": np.tile(np.arange(TREES, dtype=np.int32), len(b)), "region": keys[:, :, 0].ravel(), "deeper": keys[:, :, 1].ravel()}
            yield pd.DataFrame(rows | {c: np.repeat(b[c].to_numpy(), TREES) for c in ("id", "v", "n")})

    return reps.select("id", "v", "n", "sig").mapInPandas(run, "tree int, region long, deeper long, id long, v long, n long")


def _whole_runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of a sorted split in frames that end where a run of equal ``by`` ends, each with the run of its rows, from 0."""

    def numbered(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        new = np.zeros(len(rows), bool)
        for c in by:
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return rows, np.cumsum(new)

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        if held:
            last = [held[-1][c].iloc[-1] for c in by]
            fresh = np.flatnonzero(np.any([b[c].to_numpy() != x for c, x in zip(by, last, strict=True)], axis=0))
            if not len(fresh):
                held.append(b)
                continue
        at = int(np.flatnonzero(np.all([b[c].to_numpy() == b[c].iloc[-1] for c in by], axis=0))[0])
        done = [*held, b.iloc[:at]]
        held = [b.iloc[at:]]
        rows = pd.concat(done, ignore_index=True)
        if len(rows):
            yield numbered(rows)
    if held:
        yield numbered(pd.concat(held, ignore_index=True))


def _parts(deeper: np.ndarray, depth: int = 0) -> list[int]:
    """Where the parts of one region begin, its entries in order: the prefix grows until PART entries or fewer share it."""
    if len(deeper) <= PART:
        return [0]
    if depth == DEPTH:
        return list(range(0, len(deeper), PART))
    prefix = deeper >> np.int64(16 * (DEPTH - 1 - depth))
    edges = np.flatnonzero(np.diff(prefix, prepend=prefix[0] - 1))
    return [int(a) + x for a, b in zip(edges, np.append(edges[1:], len(deeper)), strict=True) for x in _parts(deeper[a:b], depth + 1)]


def _with_company(entries: DataFrame) -> DataFrame:
    """(tree, region, part, id, v, n) of the entries that share a region: one sort of all, dealt out by ranges of the whole order.

    So a dense region is split over tasks; a region that a range's border may cut is kept, whatever its size.
    ``part`` tells the neighbours that are looked at first.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, part, before = TaskContext.get().partitionId(), 0, None
        for rows, run in _whole_runs(batches, ["tree", "region"]):
            if before is not None:  # the run before was the split's last so far
                yield before
            size = np.bincount(run)
            if part == 0:
                size[0] += 1
            keep = size[run] > 1
            keep[run == run[-1]] = True
            rows, run = rows[keep], run[keep]
            first = np.flatnonzero(np.diff(run, prepend=-1))
            starts = np.zeros(len(rows), bool)
            starts[first] = True
            for a, b in zip(first, np.append(first[1:], len(run)), strict=True):
                if b - a > PART:
                    starts[a + np.array(_parts(rows["deeper"].to_numpy()[a:b]))] = True
            number = part + np.cumsum(starts)
            part = int(number[-1])
            before = rows.assign(part=(split << 40) + number)[["tree", "region", "part", "id", "v", "n"]]
        if before is not None:
            yield before

    order = ["tree", "region", "deeper", "id", "v"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        walk, "tree int, region long, part long, id long, v long, n long"
    )


def components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(id, comp) of every id in the edges (a, b): comp is the smallest id reachable. A table of ``work``, called ``name``.

    Each turn takes the least label among the neighbours' and then the label's own label, so long chains shorten
    by doubling; the turns are written to the shared folder, and only whether a label moved reaches the driver.
    Edges of a hub and ids of a giant component are not brought together in a task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.put(both, f"{name}-edges")
    hubs = work.put(hot_keys(both, ["b"], both.count()), f"{name}-hubs")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp"))
    turn = 0
    while True:
        near = join_spread(both, labels.withColumnRenamed("id", "b"), ["b"], hubs).select(F.col("a").alias("id"), "comp", F.lit(None).cast("long").alias("old"))
        own = near.union(labels.select("id", "comp", F.col("comp").alias("old"))).groupBy("id").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        own = work.put(own, f"{name}-own-{turn}")
        up = own.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = join_spread(own, up, ["comp"], hot_keys(own, ["comp"], own.count()))
        new = work.put(new.select("id", F.least("comp", "up").alias("comp"), (F.least("comp", "up") != F.col("old")).alias("moved")), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}", f"{name}-own-{turn}")
        labels, turn = new.select("id", "comp"), turn + 1
        if new.filter("moved").isEmpty():
            work.drop(f"{name}-edges", f"{name}-hubs")
            return labels


def _unpacked(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), HASHES)


def _fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _forest(alike: np.ndarray, likely: int, least: int) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of a part's entries, from the matrix of their equal hash values.

    Likely links first, breadth first from the entry that comes first, so that what is alike hangs on few entries;
    what these leave apart is joined by the most equal of the other candidates.
    """
    pairs, root = [], np.full(len(alike), -1)
    sure = alike >= likely
    for start in range(len(alike)):
        if root[start] >= 0:
            continue
        root[start], reached = start, [start]
        while reached:
            at = reached.pop(0)
            new = np.flatnonzero(sure[at] & (root < 0))
            root[new] = start
            pairs += [(at, int(x)) for x in new]
            reached += new.tolist()
    x, y = np.nonzero(np.triu(alike >= least, 1) & (root[:, None] != root[None, :]))
    for i in np.argsort(-alike[x, y].astype(int), kind="stable").tolist():
        a, b = root[x[i]], root[y[i]]
        if a != b:
            root[root == max(a, b)] = min(a, b)
            pairs.append((int(x[i]), int(y[i])))
    return pairs


def _neighbours(company: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, av, b, bv), a < b: spanning forests of the parts of the first trees."""
    least, likely = least_equal(percent), -(-HASHES * percent // 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, part in _whole_runs(batches, ["part"]):
            sig, n = _unpacked(rows["sig"]), rows["n"].to_numpy()
            size = np.bincount(part)
            first = np.cumsum(size) - size
            two = first[size == 2]
            two = two[((sig[two] == sig[two + 1]).sum(axis=1) >= least) & _fit(n[two], n[two + 1], percent)]
            found = [np.stack([two, two + 1], axis=1)]
            for at, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                s, k = sig[at : at + m], n[at : at + m]
                alike = np.zeros((m, m), np.uint8)
                for h in range(HASHES):
                    alike += s[:, h][:, None] == s[:, h][None, :]
                alike[~_fit(k[:, None], k[None, :], percent)] = 0
                np.fill_diagonal(alike, 0)
                found.append(at + np.array(_forest(alike, likely, least), int).reshape(-1, 2))
            x, y = np.concatenate(found).T
            ids, v = rows["id"].to_numpy(), rows["v"].to_numpy()
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            out = pd.DataFrame({"a": ids[x], "av": v[x], "b": ids[y], "bv": v[y]})
            yield out[out["a"] != out["b"]]

    rows = company.filter(F.col("tree") < FIRST_TREES).join(sigs, ["id", "v"]).select("part", "id", "v", "n", "sig")
    return rows.repartition("part").sortWithinPartitions("part", "id", "v").mapInPandas(run, "a long, av long, b long, bv long").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("v").alias("av"), F.col("set").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("v").alias("bv"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(first, ["a", "av"])
        .join(second, ["b", "bv"])
        .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def _blocks(company: DataFrame, comps: DataFrame, work: Scratch) -> DataFrame:
    """(tree, region, q, d, asks, id, v, n, comp): the entries of regions of more than one component, dealt into pairs of blocks.

    Entries outside a region's largest component ask; they are dealt into as many blocks q as they need, all
    entries into blocks d, and each asking block meets each other. A region's counts are summed before they are
    shuffled, and come to the entries of a dense region by broadcast, wherever these are.
    """
    e = company.drop("part").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    by = ["tree", "region"]
    sums = e.groupBy(*by, "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    of = sums.groupBy(*by).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("k"), F.max(F.struct("c", "comp", "s")).alias("m"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    of = of.select(
        *by, "c", "k", F.col("m.comp").alias("main"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("nq"), blocks(F.col("c"), F.col("s")).alias("nd")
    )
    of = work.put(of, "regions")
    hot = of.filter(F.col("c") * HOT_SHARE > company.count()).select(*by)
    e = join_spread(e, of.drop("c"), by, hot).filter("k > 1")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = F.transform(every("nq"), lambda q: F.struct(q.alias("q"), deal("nd").alias("d"), F.lit(False).alias("asks")))
    ask = F.transform(every("nd"), lambda d: F.struct(deal("nq").alias("q"), d.alias("d"), F.lit(True).alias("asks")))
    both = F.when(F.col("comp") != F.col("main"), F.concat(met, ask)).otherwise(met)
    return e.withColumn("b", F.explode(both)).select(*by, "b.*", "id", "v", "n", "comp")


_TASK = ["tree", "region", "q", "d"]
_ENTRY = "tree int, region long, q int, d int, asks boolean, id long, v long, n long, comp long"


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TASK).sortWithinPartitions(*_TASK, "asks", "id", "v")


def _meetings(rows: pd.DataFrame, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): rows that ask and rows of their task that do not, of different components; two that both ask meet once.

    So many at a time as PAIRS_AT_ONCE, or those of one row.
    """
    asks, ids, comp = rows["asks"].to_numpy(), rows["id"].to_numpy(), rows["comp"].to_numpy()
    size, met = np.bincount(run), np.bincount(run, ~asks).astype(int)
    first = np.cumsum(size) - size
    q = np.flatnonzero(asks)
    n = met[run[q]]
    both = set(zip(run[q].tolist(), ids[q].tolist(), strict=True)) if len(q) else set()
    opens = np.fromiter(((r, i) in both for r, i in zip(run.tolist(), ids.tolist(), strict=True)), bool, len(run)) & ~asks
    ends = np.cumsum(n)
    at = 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        x = np.repeat(q[at:stop], n[at:stop])
        y = np.arange(len(x)) - np.repeat(np.cumsum(n[at:stop]) - n[at:stop], n[at:stop]) + np.repeat(first[run[q[at:stop]]], n[at:stop])
        ok = (comp[x] != comp[y]) & ~(opens[y] & (ids[y] < ids[x]))
        yield x[ok], y[ok]
        at = stop


def _candidates(blocks: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The rows of the blocks that have a candidate in their task: a pair is looked at in the first tree whose region it shares."""
    least = least_equal(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, task in _whole_runs(batches, _TASK):
            sig, n, tree = _unpacked(rows["sig"]), rows["n"].to_numpy(), rows["tree"].to_numpy()
            has = np.zeros(len(rows), bool)
            for x, y in _meetings(rows, task):
                fit = _fit(n[x], n[y], percent)
                x, y = x[fit], y[fit]
                same = sig[x] == sig[y]
                some = same.sum(axis=1) >= least
                x, y, same = x[some], y[some], same[some]
                first = same.reshape(len(x), TREES, DEPTH).all(axis=2).argmax(axis=1) == tree[x]
                has[x[first]] = has[y[first]] = True
            yield rows.loc[has].drop(columns="sig")

    return _by_task(blocks.join(sigs, ["id", "v"]).select(*_TASK, "asks", "id", "v", "n", "comp", "sig")).mapInPandas(run, _ENTRY)


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of a task, by full sets: no more of them than there are components."""

    def linked(rows: pd.DataFrame) -> list[tuple[int, int]]:
        asks, ids, comp, n = (rows[c].to_numpy() for c in ("asks", "ids", "comp", "n"))
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(d):
            return []
        sets = [np.asarray(s) for s in rows["set"]]
        of = np.repeat(np.arange(len(d)), [len(sets[i]) for i in d])
        every = np.concatenate([sets[i] for i in d])
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]  # which entries have a shingle
        up: dict[int, int] = {}
        out = []

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        for i in q.tolist():
            a, b = np.searchsorted(every, sets[i], side="left"), np.searchsorted(every, sets[i], side="right")
            m = b - a
            hits = of[np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            both = np.bincount(hits, minlength=len(d))
            for j in d[100 * both >= percent * (n[i] + n[d] - both)].tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, task in _whole_runs(batches, _TASK):
            rows = rows.rename(columns={"id": "ids"})
            edges = np.flatnonzero(np.diff(task, prepend=-1, append=-1))
            found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in linked(rows.iloc[a:b])]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _by_task(rows.join(sets, ["id", "v"]).select(*_TASK, "asks", "id", "v", "n", "comp", "set")).mapInPandas(run, "a long, b long").distinct()


def _one_key(usable: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that have one key and different sets; None if no key has."""
    many = usable.groupBy("id").agg(F.min("k1").alias("_x"), F.max("k1").alias("_y")).filter("_x != _y").select("id")
    if many.isEmpty():
        return None
    of = usable.join(many, "id").select("id", "n", "k1", "k2").join(reps.select("n", F.col("v").alias("k1"), "k2", F.col("id").alias("rep")), ["n", "k1", "k2"])
    return of.filter("id != rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept: one row per row of ``docs``.

    component_id is the smallest key reachable by links (similarity of percent or more); kept marks that document. A null or empty text has no
    shingles and is linked with nothing; a row without a key is a component of its own (component_id null, kept).
    Rows with one key count as one document: they share a component (but for rows without words, which are alone),
    and a repeated row is kept as often as it stands there. Keys are integers. Columns other than key and text are
    not looked at. Tables that the job writes on the way are deleted, but for the two that the result is read from.
    """
    work = Scratch(docs.sparkSession, "near")
    signed = work.put(_signed(docs, key, text), "signed")
    usable = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    # texts with equal sets are one class, told by its smallest id, and by v where rows with one key differ
    reps = usable.groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    reps = work.put(reps.withColumnRenamed("k1", "v"), "reps")
    sigs = reps.select("id", "v", "sig")
    company = work.put(_with_company(_trees(reps)), "company")
    # only documents that share a region are looked at again: their full sets are made once, and kept
    asked = company.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    texts = among(texts, "id", asked).dropDuplicates(["id", "t"])

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "v": [told(s) for s in sets], "set": [s.view(np.int64) for s in sets]})

    sets = work.put(texts.mapInPandas(sets_of, "id long, v long, set array<long>"), "sets")
    links = _confirm(_neighbours(company, sigs, percent), sets, percent)
    twice = _one_key(usable, reps)
    links = work.put(links if twice is None else links.union(twice), "links")
    comps = components(links, work, "first")
    rows = work.put(_candidates(_blocks(company, comps, work), sigs, percent), "candidates")
    work.drop("company", "links", "regions")
    more = work.put(_links(rows, sets, percent), "more")
    work.drop("candidates", "sets")
    if not more.isEmpty():
        comps = components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more), work, "second")
    labels = reps.join(comps, "id", "left").select("n", F.col("v").alias("k1"), "k2", F.coalesce("comp", "id").alias("c"))
    labels = work.put(labels, "labels")
    work.keep("signed", "labels")
    done = usable.select("id", "n", "k1", "k2").join(labels, ["n", "k1", "k2"]).select("id", "n", "c")
    lone = signed.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("c"))
    return done.union(lone).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("c").alias("component_id"),
        F.col("id").eqNullSafe(F.col("c")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs in SQL are too slow on whole tables; the tests compare with a brute-force version.
SQL = None
