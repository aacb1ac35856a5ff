"""The corpus operators: SQL twins, brute force, exact round trips, held-out accuracy, and odd inputs of every kind."""

import collections
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, values
from pyspark.sql import functions as F

from transcript_jobs.llm import html_text as H
from transcript_jobs.llm import labelled, merkle, mixing, near_dups, packing, preferences, quality_model, quality_rules, registry, sharding, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} is{i}." for i in range(30_000))
ODD = [
    (1, "Plain words, and a few more of them here.\nSecond line.\nSecond line.", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "   \n\t ", "en", "b"),
    (5, LONG, "en", "a"), (6, "one", "en", None), (7, "Plain words, and a few more of them here.\nSecond line.\nSecond line.", "en", "a"),
    (7, "Plain words, and a few more of them here.\nSecond line.\nSecond line.", "en", "a"), (None, "no key at all", "en", "c"), (9, "😀 é <|endoftext|>  two  spaces\x0b", "de", "c"),
    (10, "x" * 5000, "en", "a"),
]
#: Columns of docs that operators make themselves.
CLASH = (
    "score size target taken shard slot n_words kept bits n_shingles component_id fingerprint sequence_id start length n tree region id key t y "
    "sn s0 h u r k v _t _r _n _key _x0 _x1 _text _id _w _l _m g _b a.dot `tick"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in ODD], DOC)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts():
    return [r[1] or "" for r in ODD]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    assert values(registry.queries()[name](spark, SF).toPandas()) == values(duck.sql(registry.oracle_sql()[name]).df())


# --- packing


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([5, 8, 16])
        at = [0, *itertools.accumulate(rng.randint(1, length) for _ in range(rng.randint(1, 9)))]
        cost = [0] + [rng.choice([0, 1, 2, 7]) for _ in at[1:]]
        price = lambda cuts: sum(length - (b - a) for a, b in itertools.pairwise(cuts)) + sum(cost[at.index(c)] for c in cuts[1:])  # noqa: B023, E731
        ways = ([0, *c, at[-1]] for n in range(len(at)) for c in itertools.combinations(at[1:-1], n))
        best = min(price(w) for w in ways if all(b - a <= length for a, b in itertools.pairwise(w)))
        got = packing.best_cuts(np.array(at), np.array(cost), length)
        assert price(got) == best and all(b - a <= length for a, b in itertools.pairwise(got))


def check_packing(rows, docs_in):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter((k, tuple([*tok.encode(t, add_special_tokens=False).ids, 0])) for k, t in docs_in)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    got = collections.Counter()
    pieces = rows.sort_values(["sequence_id", "offset"]).to_dict("records")
    open_: dict = {}
    for p in pieces:  # in stream order a document's pieces follow each other
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"])
        key = None if p["doc_id"] != p["doc_id"] else int(p["doc_id"])
        have = open_.pop(key, ())
        assert len(have) == p["start"]
        have += tuple(p["ids"])
        if len(have) == p["doc_tokens"]:
            got[(key, have)] += 1
        else:
            open_[key] = have
    assert not open_ and got == want


def test_packing(spark, odd, docs):
    check_packing(packing.pack(odd.coalesce(1), with_ids=True).toPandas(), [(r[0], r[1] or "") for r in ODD])
    rows = packing.pack(docs.coalesce(1), with_ids=True).toPandas()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert 1 - rows.length.sum() / 1024 / rows.sequence_id.nunique() < 0.02
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_small_blocks():
    enc = packing.ids_of(packing.default_tokenizer())
    out = list(packing.pack_stream(iter([([1, 2, 3], [LONG[:20_000], "a b", LONG[:9_000]])]), enc, block=3000))
    by = collections.defaultdict(list)
    for o in out:
        for k, s, ids, q in zip(o["key"], o["start"], o["ids"], o["sequence"]):
            by[k].append((s, list(ids), q))
    for k, t in ((1, LONG[:20_000]), (2, "a b"), (3, LONG[:9_000])):
        assert sum((x[1] for x in sorted(by[k])), []) == enc.batch([t])[0].tolist()


def test_ids_are_the_tokenizers():
    """Every kind of white space beside spaces, letters, marks and special tokens."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, enc, rng = Tokenizer.from_file(path), packing.Ids(path), random.Random(11)
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert {"\xa0", "\u3000", "\t", "\n", "\x1c", "\x85"} <= set(white)
    for few in [white, [" ", "\xa0"], [" ", "\n"], [" ", "\u3000", "\n"], [" "]]:
        parts = [*few, " ", " ", "a", "Zé", "'s", "7", ".", "語", "<|endoftext|>"]
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
        want = tok.encode_batch(texts, add_special_tokens=False)
        for t, w, got in zip(texts, want, enc.batch(texts), strict=True):
            assert got.tolist() == [*w.ids, 0], repr(t)


@pytest.mark.parametrize("length", [1, 2, 7, 16, 40])
def test_packing_short_sequences(length):
    enc = packing.ids_of(packing.default_tokenizer())
    out = list(packing.pack_stream(iter([([1, 2], [LONG[:3000], "a b"])]), enc, length=length, block=500))
    assert all(1 <= n <= length for o in out for n in o["length"]) and sum(int(o["length"].sum()) for o in out) == sum(map(len, enc.batch([LONG[:3000], "a b"])))


def test_packing_over_partitions(spark, docs):
    """Every split numbers its own sequences, and the pieces of all splits are those of the documents."""
    many = docs.repartition(7, "doc_id")
    rows = packing.pack(many, with_ids=True).toPandas()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert (rows.sequence_id // 2**40).nunique() == 7
    for _, s in rows.drop_duplicates("sequence_id").groupby(rows.sequence_id // 2**40):
        assert sorted(s.sequence_id % 2**40) == list(range(len(s)))


# --- near duplicates


def near_truth(rows, percent=85):
    """Components by comparing all pairs of word shingle sets."""
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = [k for k, _ in rows]
    same = {i: i for i in range(len(rows))}

    def find(i):
        while same[i] != i:
            i = same[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if (n and 100 * n >= percent * len(sets[i] | sets[j])) or (comp[i] is not None and comp[i] == comp[j] and sets[i] and sets[j]):
            same[find(i)] = find(j)
    least: dict = {}
    for i, k in enumerate(comp):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((-1 if k is None else k, len(s), -1 if k is None else least[find(i)]) for i, (k, s) in enumerate(zip(comp, sets)))


def near_case(spark, rows):
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert ((got.doc_id == got.component_id) | got.doc_id.isna()).tolist() == got.kept.tolist()
    return sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_shingles, got.component_id.fillna(-1).astype(int)))


def test_near_duplicates_odd(spark, odd):
    got = near_dups.near_duplicates(odd).toPandas()
    rows = [(r[0], r[1]) for r in ODD if r[0] != 5]
    have = got[got.doc_id.isna() | (got.doc_id != 5)]
    assert sorted(zip(have.doc_id.fillna(-1).astype(int), have.n_shingles, have.component_id.fillna(-1).astype(int))) == near_truth(rows)
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def family(rng, base, n, edits, words):
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


def test_near_duplicates_brute_force(spark, monkeypatch):
    """A large group of near copies, families just below the threshold, copies, and unrelated texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    t = list(family(rng, fresh(200), 60, 1, words)) + list(family(rng, fresh(150), 40, 4, words)) + [" ".join(fresh(rng.randint(1, 80))) for _ in range(60)]
    t += list(family(rng, fresh(120), 40, 2, words)) + [t[0].upper()] * 5 + [t[3]] * 20
    rng.shuffle(t)
    rows = list(enumerate(t))
    want = near_truth(rows)
    assert near_case(spark, rows) == want
    # without neighbours, all is left to the blocks, and these are small
    monkeypatch.setattr(near_dups, "FIRST_TREES", 0)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    assert near_case(spark, rows) == want


def test_near_duplicates_in_a_dense_region(spark, monkeypatch):
    """Texts that share a long passage but are no near copies stand among near copies; every link is found, and no other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage = fresh(160)
    t = [" ".join(passage + fresh(rng.choice((8, 12, 16, 20)))) for _ in range(90)] + list(family(rng, passage, 60, 3, words)) + list(family(rng, passage + fresh(30), 30, 1, words))
    rows = list(enumerate(t))
    want = near_truth(rows)
    assert 10 < len({c for _, _, c in want}) < 120
    assert near_case(spark, rows) == want
    monkeypatch.setattr(near_dups, "BLOCK", 20)
    monkeypatch.setattr(near_dups, "FIRST_TREES", 1)
    assert near_case(spark, rows) == want


def test_near_duplicates_of_repeated_keys(spark):
    """Two texts under one key link their groups; a repeated row changes nothing."""
    a, b, c = ("alpha beta gamma delta one two", "some other words that are here now", "nothing of this is in the others")
    rows = [(3, b), (5, a), (5, b), (5, b), (8, a), (9, c), (9, c), (10, None), (10, c), (11, "")]
    assert near_case(spark, rows) == near_truth(rows)


def test_parts_grow():
    order = np.sort(np.random.default_rng(1).integers(0, 3, (5000, 4)).astype(">u2"), axis=0)
    order = order[np.lexsort(order.T[::-1])]
    deeper = np.ascontiguousarray(order).view(">i8")[:, 0].astype(np.int64)
    edges = [*near_dups._parts(deeper), len(deeper)]
    sizes = np.diff(edges)
    assert edges[0] == 0 and (sizes > 0).all() and sizes.max() <= near_dups.PART
    whole = {int(x): int(n) for x, n in zip(*np.unique(deeper, return_counts=True))}
    assert all(deeper[e - 1] != deeper[e] or whole[int(deeper[e])] > near_dups.PART for e in edges[1:-1])


def test_forest_spans():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m = int(rng.integers(3, 30))
        alike = np.triu(rng.integers(40, 97, (m, m)), 1)
        alike[rng.random((m, m)) < 0.8] = 0
        alike = (alike + alike.T).astype(np.uint8)
        pairs = near_dups._forest(alike, 82, 60)
        assert all(alike[p] >= 60 for p in pairs) and len(pairs) < m

        def parts(links):
            of = list(range(m))
            for x, y in links:
                of = [of[x] if o == of[y] else o for o in of]
            return len(set(of))

        assert parts(pairs) == parts(zip(*np.nonzero(alike >= 60))) == m - len(pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 90)]
    got = dict(near_dups.components(spark.createDataFrame(chain, "a long, b long"), near_dups.Scratch(spark, "test"), "c").collect())
    assert all(got[i] == 0 for i in range(41)) and got[90] == 0 and got[100] == got[200] == got[150] == 100


def test_components_of_hubs(spark):
    """Stars whose hub has a third of all edges, their hub the least or the greatest of their ids, beside a long chain and pairs."""
    star = [(0, i) for i in range(1, 3000)] + [(9999, i) for i in range(3000, 6000)]
    chain = [(i, i + 1) for i in range(20000, 20300)]
    rest = [(i, i + 1) for i in range(30000, 36000, 2)]
    got = dict(near_dups.components(spark.createDataFrame(star + chain + rest, "a long, b long"), near_dups.Scratch(spark, "test"), "c").collect())
    want = {i: 0 for i in range(3000)} | {i: 3000 for i in [*range(3000, 6000), 9999]} | {i: 20000 for i in range(20000, 20301)}
    assert got == want | {i: i - i % 2 for i in range(30000, 36000)}


def test_join_spread(spark):
    """The rows of an inner join, nulls dropped; rows of hot keys come by broadcast, so no shuffled task holds them."""
    from transcript_jobs.llm.common import HOT_SHARE, hot_keys, join_spread

    rows = spark.range(20000).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id WHEN id < 100 THEN NULL ELSE 8 END").alias("k"), "id")
    facts = rows.select("k").distinct().withColumn("f", F.coalesce("k", F.lit(0)) * 2)
    hot = hot_keys(rows, ["k"], 20000)
    assert {r["k"] for r in hot.collect()} >= {7, 8} and hot.count() < HOT_SHARE
    got = join_spread(rows, facts, ["k"], hot)
    assert got.columns == ["k", "id", "f"] and rows_of(got) == rows_of(rows.join(facts, "k").select("k", "id", "f"))
    assert rows_of(join_spread(rows, facts, ["k"], hot.limit(0))) == rows_of(got)
    assert join_spread(rows.limit(0), facts, ["k"], hot_keys(rows.limit(0), ["k"], 0)).count() == 0


# --- html


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = H.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


MADE = [
    ('<body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-banner>We use cookies</div><ul class="menu"><li><a href=x>A</a><li><a>B</a></ul>'
     '<div class="content"><h1>Title</h1><p>One <b>bo</b>ld &nbsp;text.<p>Two<br>three<div class="ad-slot">Buy now</div><table><tr><td>c1<td>c2</table></div>'
     '<div class=sidebar><p>side text which is a long paragraph</div><section id="comments"><article><p>nice post</p></article></section><footer>&copy; x</footer>',
     "Title\nOne bold text.\nTwo three\nc1\nc2"),
    ("<p>Just one.</p><p>Second para &amp; more</p><form><input><label>Name</label></form><!-- x --><p>un<i>fin", "Just one.\nSecond para & more\nunfin"),
    ("<nav><a>x</a><article><p>Body text</p></article><aside>no</aside><script>var a='<p>no';</script>", "Body text"),
    ('<main><header><h2>Head</h2></header><p style="display:none">hidden</p><p>Text &lt;b&gt; &#233;</p></main>', "Head\nText <b> é"),
    ('<article><h1>T</h1><p>a</p><div class="share-buttons"><a>Tweet</a></div><p>b</p><div role="alert">Note</div></article>', "T\na\nb"),
    ("plain text only, with no tags at all in it anywhere, long enough", "plain text only, with no tags at all in it anywhere, long enough"),
    ("", ""), (None, ""), ("<div><p>cut <a hre", "cut"), ("<script>only()", ""),
]


def test_made_pages(spark):
    rows = spark.createDataFrame([(i, "u", h, "clash", "n") for i, (h, _) in enumerate(MADE)], "page_id long, url string, html string, text string, n_chars string")
    got = {r["page_id"]: r["text"] for r in H.extract(rows).collect()}
    assert got == {i: t for i, (_, t) in enumerate(MADE)}
    assert H.extract(rows.limit(0)).count() == 0


# --- preferences


def test_preferences(spark):
    t = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good <|end|>"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "why"),
         (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 5, "assistant", "alone"), (4, "chosen", 0, "user", "x"), (4, "chosen", 0, "user", "x"), (4, "rejected", 0, "user", "x")]
    got = preferences.format_pairs(spark.createDataFrame(t, "pair_id long, side string, turn long, role string, text string").withColumn("start", F.lit("clash"))).collect()
    rows = sorted((r["pair_id"], r["part"], r["turn"], r["start"], r["rendered"], r["trained"]) for r in got)
    hi, same = "<|user|>\nhi<|end|>\n", "<|user|>\nsame<|end|>\n"
    assert rows[:4] == [(1, "chosen", 1, 0, "<|assistant|>\ngood < |end|><|end|>\n", True), (1, "prompt", 0, 0, hi, False), (1, "rejected", 1, 0, "<|assistant|>\nbad<|end|>\n", True), (1, "rejected", 2, len("<|assistant|>\nbad<|end|>\n"), "<|user|>\nwhy<|end|>\n", False)]
    assert (2, "prompt", 0, 0, same, False) in rows and sum(r[0] == 2 for r in rows) == 1
    assert [r[1] for r in rows if r[0] == 4] == ["chosen", "chosen", "rejected"]


def test_preferences_odd(spark):
    rows = [(0, 0, "user", None), (0, None, None, "x"), (1, 3, "assistant", ""), (None, 0, "user", "lost"), (5, 0, "user", "only rejected"), (0, 0, "user", None)]
    got = preferences.format_pairs(preferences.pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).toPandas()
    assert set(got.pair_id) == {0, 2} and set(got[got.pair_id == 2].part) == {"rejected"}
    assert preferences.format_pairs(preferences.pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_paired(spark, monkeypatch):
    """The blocks of a pair put together are its turns in order, and spans are those of the assistant's turns of completions."""
    conv = [(k, t, "assistant" if t % 2 else "user", f"turn {t} of {k if t > 5 else 0} é" * (1 + t % 3)) for k in (0, 1, 4, 5, 6) for t in range(12)]
    conv += [(8, None, "assistant", None), (8, None, "user", ""), (None, 1, "user", "x")]
    rows = preferences.format_pairs(preferences.pairs(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string"))).cache()
    flat = rows.toPandas()
    for block in (1000, 5):
        monkeypatch.setattr(preferences, "TURNS_PER_BLOCK", block)
        got = preferences.paired(rows).toPandas()
        if block == 1000:
            assert got.pair_id.is_unique or set(got[got.pair_id == 4].block) == {-1}
        for pair, own in flat.groupby("pair_id"):
            mine = got[got.pair_id == pair].sort_values("block")
            for part in ("prompt", "chosen", "rejected"):
                want = own[own.part == part].sort_values("start")
                text = "".join(want.rendered)
                assert "".join(mine[part]) == text
                if part != "prompt":
                    spans = [(s["start"], s["end"]) for x in mine[f"{part}_spans"] for s in x]
                    assert spans == [(s, s + len(r)) for s, r, t in zip(want.start, want.rendered, want.trained) if t]
                    assert all(text[a:b].startswith("<|assistant|>") for a, b in spans)
    assert preferences.paired(rows.limit(0)).count() == 0


# --- classifiers


def test_held_out(spark):
    got = spark.createDataFrame([(i,) for i in range(200)], "doc_id long").select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_quality(spark):
    big = SF.replace("0.001", "0.1")
    got = quality_model.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98 and got.score.between(0, 1).all()


def test_tree_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality_model.STATISTICS)))
    m = quality_model.train(x, ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float))

    def walk(row):
        z = m.base
        for t in range(len(m.feature)):
            n = 0
            while m.left[t][n] != n:
                n = m.left[t][n] if row[m.feature[t][n]] <= m.threshold[t][n] else m.right[t][n]
            z += m.value[t][n]
        return 1 / (1 + np.exp(-z))

    s = m.score(x)
    assert np.allclose(s, [walk(r) for r in x]) and ((s > 0.5) == ((x[:, 0] > 0.3) ^ (x[:, 2] > 0))).mean() > 0.95


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifiers_odd(spark, odd, module, label):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (6, 0), (6, None), (7, 0), (10, 1), (None, 1)], f"doc_id long, {label} int")
    model = module.fit(odd, labels)
    got = module.score(odd, model).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all() and set(CLASH) <= set(got.columns)
    none = module.fit(odd, labels.limit(0))
    assert module.score(odd, none).toPandas().score.nunique() == 1 and module.score(odd.limit(0), model).count() == 0


def test_toxicity_learns_subwords():
    rng = random.Random(2)
    words = [a + b for a in ("th", "er", "on", "an", "ti", "re", "wh") for b in ("ea", "in", "ou", "st", "nd", "ly")]
    text = lambda bad: " ".join(rng.choice(words) if not bad or rng.random() > 0.05 else "blorg" + rng.choice(words) for _ in range(100))
    y = np.array([i % 4 == 0 for i in range(800)], int)
    model = toxicity.train([text(v) for v in y], y)
    new = model.score([text(v) for v in y])
    assert ((new >= 0.7) == (y == 1)).mean() > 0.97
    assert model.score(["blorgunseen"])[0] > 0.5 > model.score(["unseen word"])[0]
    # the score is that of the highest window, by brute force over all
    t = toxicity.tokens(text(1))
    share = np.array([np.mean(model.share[toxicity.word_ngrams([w])[1]]) for w in t])
    z = max(share[i : i + toxicity.WINDOW].sum() / toxicity.WINDOW for i in range(len(t) - toxicity.WINDOW + 1)) + model.bias
    assert np.isclose(model.score([" ".join(t)])[0], 1 / (1 + np.exp(-z)))


# --- sharding


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(100):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 40))), reverse=True)
        rooms, want, bins = [rng.randint(0, 100) for _ in range(3)], [], None
        bins = list(rooms)
        for s in sizes:  # the tightest bin by looking at all
            fits = [(r, i) for i, r in enumerate(bins) if r >= s]
            if not fits:
                bins.append(100)
            i = min(fits)[1] if fits else len(bins) - 1
            bins[i] -= s
            want.append(i)
        assert sharding.best_fit_decreasing(sizes, rooms, 100) == want


def check_shards(got, rows):
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in rows)
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert got.groupby("text_crc32").shard.nunique().max() == 1 and got.shard.between(0, 7).all()


def test_sharding(spark, odd, docs, monkeypatch):
    check_shards(sharding.shard(odd).toPandas(), texts())
    monkeypatch.setattr(sharding, "GROUPS_PER_BLOCK", 25)
    got = sharding.shard(docs).toPandas()
    check_shards(got, [r["text"] for r in docs.collect()])
    by = got.groupby("shard")["size"].sum()
    assert by.max() - by.min() < 0.05 * by.mean()
    assert sharding.shard(odd.limit(0)).count() == 0
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 30)
    hot = [(i, "" if i % 3 else "same text" if i % 2 else f"text {i}") for i in range(600)]  # many rows of few bytes, and a hot text
    check_shards(sharding.shard(spark.createDataFrame(hot, "doc_id long, text string")).toPandas(), [t for _, t in hot])
    packed = sharding.pack_capacity(docs, 20_000).toPandas()
    assert all(s["size"].sum() <= 20_000 or s["size"].nunique() == 1 for _, s in packed.groupby(["block", "bin"]))


# --- merkle


def test_merkle(spark, odd):
    got = merkle.fingerprints(odd).toPandas()
    order = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in ODD)
    assert len(got) == len(ODD)
    rows = sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_chars, got.edited_sha256))
    import hashlib

    want = []
    for i, (k, t) in enumerate(order):
        nxt, q = order[(i + 1) % len(order)][1], len(t) // 4
        want.append((k, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert rows == sorted(want)
    same = got[got.doc_id == 7]
    assert same.fingerprint.nunique() == 1 and set(got[got.doc_id == 1].fingerprint) == set(same.fingerprint) and got.near_edited.between(0, 1).all()
    assert merkle.fingerprints(odd.limit(0)).count() == 0
    only = merkle.fingerprints(odd.filter("doc_id = 1")).toPandas()
    assert only.near_next[0] == 1.0


def test_merkle_ranges(spark, monkeypatch):
    """Small ranges, repeated and missing keys: every row has the next one's text."""
    monkeypatch.setattr(merkle, "RANGE_BYTES", 500)
    rng = random.Random(6)
    rows = [(rng.choice([None, rng.randrange(40), rng.randrange(10**12)]), f"text {rng.randrange(10**6)}. " * rng.randint(0, 6)) for _ in range(400)]
    got = merkle.with_next(spark.createDataFrame(rows, "_id long, _t string").repartition(5), "_id", "_t", F.upper).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(k, t, t.upper(), order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order)]
    assert collections.Counter((r["_id"], r["_t"], r["_more"], r["next__t"]) for r in got) == collections.Counter(want)
    assert all(r["next__more"] == r["next__t"].upper() for r in got)
    bounds = sorted(rng.randrange(100) for _ in range(37))
    at = spark.range(-3, 105).select("id", merkle._place(sorted(set(bounds)), F.col("id")).alias("p")).collect()
    assert all(r["p"] == sum(b <= r["id"] for b in set(bounds)) for r in at)


def test_merkle_locates_edits(spark):
    a = "\n".join(f"Paragraph {i} says something about {i * i}." for i in range(60))
    b = a.replace("Paragraph 30 ", "Paragraph thirty ")
    r = spark.createDataFrame([(a, b)], "a string, b string").select(*[merkle.fingerprint(F.col(c)).alias(c) for c in "ab"])
    r = r.select("*", merkle.likeness(F.col("a"), F.col("b")).alias("l"), merkle.changed_sections(F.col("a"), F.col("b")).alias("s")).head()
    assert 0.9 < r["l"] < 1 and len(r["s"]) == 1 and r["a"].split("|")[0] != r["b"].split("|")[0]


# --- mixing


def test_mixing(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    m = mixing.mix(odd)
    got = m.toPandas()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in ODD:
        sizes[r[3]] += n(r[1])
    total, cap = sum(sizes.values()), {s: 2.0 * v for s, v in sizes.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, full = {}, set()
    while True:  # the excess goes round until none is above
        rest = 1.5 * total - sum(cap[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: cap[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in sizes}
        over = {s for s in open_ if target[s] > cap[s]}
        if not over:
            break
        full |= over
    assert len(got) == len(ODD)
    for s, g in got.groupby(got.source.fillna("-")):
        s = None if s == "-" else s
        assert np.allclose(g.target, target[s]) and (g.source_size == sizes[s]).all() and abs(g.taken.sum() - target[s]) <= 2  # copies share
    assert (got.taken <= 2 * got["size"]).all()
    assert sorted(got.taken) == sorted(mixing.mix(odd.repartition(3)).toPandas().taken)
    out = mixing.apply_mix(m).toPandas()
    assert sum(n(t) for t in out.text) == got.taken.sum() and set(out.text.dropna()) - set(texts()) <= {t for t in out.text.dropna() if any(x.startswith(t) for x in texts())}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_sizes(spark, odd):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert values(mixing.mix_sizes(odd).toPandas()[cols]) == values(mixing.mix(odd).toPandas()[cols])


def test_mixing_many_copies(spark):
    """A row that stands there often shares the end of its source's budget; no copy is told from another."""
    rows = [(1, "a b c d", "x")] * 30 + [(2, "e f", "x"), (3, "g " * 500, "y"), (4, "h", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 30
    assert got[got.doc_id == 1].taken.nunique() == 1


def test_mixing_by_a_weight(spark):
    """Documents of a larger weight come first, about as often as their weight says."""
    rows = [(i, "w " * 10, "x", None if i % 9 == 0 else 20.0 if i % 3 else 1.0) for i in range(3000)] + [(i, "w " * 10, "y", 1.0) for i in range(3000, 9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), weight="w").toPandas()
    x = got[got.source == "y"]
    assert abs(x.taken.sum() - x.target.iloc[0]) <= 1
    x = got[got.source == "x"].assign(more=lambda d: d.taken > d["size"] * (d.target // d.source_size))
    rest = x.target.iloc[0] % x.source_size.iloc[0]
    if rest:
        assert x[x.w == 20].more.mean() >= x[x.w == 1].more.mean() >= x[x.w.isna()].more.mean()
    with pytest.raises(ValueError):
        mixing.mix(got.pipe(lambda d: spark.createDataFrame(d[["doc_id", "text", "source"]])), weight="none")


# --- rules


def test_rules(spark, odd):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd)).toPandas()

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, rows[cols].itertuples(index=False))) == sorted(brute(t) for t in texts())
    assert quality_rules.ledger(odd.limit(0)).count() == 0


@pytest.mark.parametrize("words", [["a"] * 10, ["a", "b"] * 8, ["a", "b", "c", "d"], ["a", "b", "c", "x", "a", "b", "c"], ["a", "a", "a"], ["a"], list("abcdabceabcd")])
def test_repeats(spark, words):
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert spark.createDataFrame([(words,)], "w array<string>").select(quality_rules.repeat_words(F.col("w")).alias("r")).head()["r"] == len(hit)


def test_ablation(spark):
    bits = [0, 1, 1 | 4, 4, 64, 2 | 64]
    rows = spark.createDataFrame([(b,) for b in bits], "bits long")
    got = {r["rule"]: (r["failed"], r["failed_alone"], r["kept"]) for r in quality_rules.ablation(rows).collect()}
    assert got["few_words"] == (2, 1, 1) and got["symbols"] == (2, 1, 1) and got["shouting"] == (2, 1, 1) and got["repeated_windows"] == (1, 0, 1)
    assert {r["kept"] for r in quality_rules.ablation(rows.limit(0)).collect()} == {0}
    old = quality_rules.apply_policy(rows.withColumn("doc_id", F.lit(1)), 1).filter("kept").count()
    assert old == 3


# --- pipeline


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    rows = [(1, 1, 0), (3, 0, 0), (5, 1, 1), (6, 0, 0), (6, None, None), (7, 0, 1), (10, 1, 0), (None, 1, 1), (9, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return collections.Counter(map(str, df.collect()))


@pytest.mark.parametrize("name", [n for n, _ in __import__("corpus_pipeline").STAGES])
def test_stage_odd(spark, odd, labels, name):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns of any name, which come out as they went in."""
    import corpus_pipeline as C

    stage = dict(C.STAGES)[name]
    names = {"t": "Score", "y": "N_chars2", "v": "SIZE2"}
    docs = odd.toDF(*[names.get(c, c) for c in odd.columns])
    out = stage(spark, docs, labels)
    got = out.collect()
    assert stage(spark, docs.limit(0), labels).count() == 0
    if name == "packing":
        return check_packing(packing.pack(docs.coalesce(1), with_ids=True).toPandas(), [(r[0], r[1] or "") for r in ODD])
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before, after = rows_of(docs), rows_of(out)
    if name == "mixing":
        assert {r["doc_id"] for r in got} <= {r[0] for r in ODD} and all(r["score"] == r["Score"] == r["size"] == r["a.dot"] == "clash" for r in got)
        return
    assert not after - before
    if name in ("quality", "toxicity"):
        fit = {"quality": quality_model, "toxicity": toxicity}[name]
        table = spark.read.parquet(f"{labels}/labels.parquet")
        scored = fit.score(docs.select("doc_id", "text"), fit.fit(docs, table)).toPandas()
        keep = scored.score >= 0.5 if name == "quality" else scored.score < toxicity.ACCEPT
        assert collections.Counter(scored[keep].doc_id.fillna(-1)) == collections.Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in got)
    if name == "near_dups":
        want = collections.Counter(c for _, _, c in near_truth([(r[0], r[1]) for r in ODD if r[0] != 5]) if c != -1).keys() | {5}
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter([*want, None])


def test_stage_keeps_one_of_two_texts(spark):
    """Of rows with one doc_id and different texts the one of the least text stays, whatever the partitions."""
    import corpus_pipeline as C

    rows = [(5, "b b b b b b b", {"x": 1}), (5, "a a a a a a a c", {"x": 2}), (5, "c", {"x": 3}), (6, "d", None), (7, "d", None), (None, "d", None), (None, None, None)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>").repartition(parts)
        got = sorted((r["doc_id"] or -1, r["text"] or "") for r in C.dedup(spark, docs, "").collect())
        assert got == [(-1, ""), (-1, "d"), (5, "a a a a a a a c"), (6, "d")]


def test_toxicity_stage_on_held_out_labels(spark):
    """Op5 and the stage against labels that were not learned from."""
    import corpus_pipeline as C

    big = SF.replace("0.001", "0.1")
    docs, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.query(spark, big).join(marks, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96 and got[got.toxic == 1].predicted.mean() > 0.7
    kept = {r["doc_id"] for r in C.toxic(spark, docs, big).select("doc_id").collect()}
    assert (got.doc_id.isin(kept) == (got.predicted == 0)).mean() > 0.995


def test_among(spark):
    from transcript_jobs.llm.common import among

    rows = spark.createDataFrame([(i, "x") for i in [*range(200), None, 7]], "k long, t string")
    ids = spark.range(0, 200, 3).withColumnRenamed("id", "other")
    assert sorted(r["k"] for r in among(rows, "k", ids).collect()) == list(range(0, 200, 3))
    assert sum(r["k"] is None for r in among(rows, "k", ids, "left_anti").collect()) == 1
    assert among(rows, "k", ids, "left_anti").count() == 202 - 67 and among(rows, "k", ids.limit(0), "left_anti").count() == 202


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("x"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before = docs
    for name, stage in C.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
        ids = {r[0] for r in before.select("doc_id").collect()}
        kept = [r[0] for r in after.select("doc_id").collect()]
        assert set(kept) <= ids
        if name == "quality":
            got = labels.filter(labelled.held_out(F.col("doc_id"))).toPandas()
            assert (got.doc_id.isin(kept) == (got.quality == 1)).mean() > 0.95
        if name == "near_dups":
            truth = near_truth([(r["doc_id"], r["text"]) for r in before.collect()], C.NEAR_PERCENT)
            assert sorted(kept) == sorted({c for _, _, c in truth})
        if name == "mixing":
            size = lambda d: {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
            a, b = size(before), size(after)
            assert abs(sum(b.values()) - 1.5 * sum(a.values())) < 50 and all(b[s] <= 2 * a[s] for s in b)
        if name == "packing":
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).head()[0] <= 1024
            assert after.agg(F.sum("length")).head()[0] == sum(len(x) + 1 for x in _ids([r["text"] for r in before.collect()]))
        before = after
    assert C.run(spark, SF).count() > 0


def _ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
