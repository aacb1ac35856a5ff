"""Models: no row with another's answer, no hang, no failed job; batches by a cost model; vectors that are made once."""

import itertools
import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from transcript_jobs.jobs import flows
from transcript_jobs.operators import models, questions


def echo(batch):
    return [m[-1]["content"] for m in batch]


class Model:
    """A model made of a function of the batch."""

    def __init__(self, f, takes_limits=False):
        self.f, self.takes_limits = f, takes_limits

    def load(self):
        return self.f


def asked(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return rows.withColumn("messages", questions.messages(F.lit("s"), F.col("t")))


def answers(spark, f, texts, **more):
    return {r["t"]: (r["output"], r["error"]) for r in models.generate_column(asked(spark, texts), "messages", Model(f), **more).collect()}


TEXTS = [f"p{i}" + "x" * (i % 5) for i in range(40)]


@pytest.mark.parametrize(
    "f",
    [
        lambda b: echo(b)[:-1],  # one too few
        lambda b: echo(b) + ["more"],  # one too many
        lambda b: [],  # none
        lambda b: echo(b) * 2,
        lambda b: None,
        lambda b: [None] * len(b),
        lambda b: [7] * len(b),
        lambda b: (_ for _ in echo(b)[1:]),
    ],
)
def test_wrong_number_or_kind_of_completions(spark, f):
    """Each row has its own answer or an error."""
    got = answers(spark, f, TEXTS)
    assert len(got) == 40
    for t, (output, error) in got.items():
        assert (output is None and error) or (output == t and error is None)


def test_faulty_batches_only(spark):
    """A model that drops answers from full batches alone still answers every row."""
    got = answers(spark, lambda b: echo(b)[: max(1, len(b) - 1)], TEXTS)
    assert got == {t: (t, None) for t in TEXTS}


def test_bad_rows_do_not_cost_the_others(spark):
    def f(batch):
        if any("13" in m[-1]["content"] for m in batch):
            raise ValueError("unlucky")
        return echo(batch)

    got = answers(spark, f, TEXTS)
    assert got["p13xxx"] == (None, "ValueError: unlucky") and sum(e is not None for _, e in got.values()) == 1


def test_only_memory_halves_the_batch():
    sizes = []

    def f(rows):
        sizes.append(len(rows))
        if len(rows) > 3:
            raise RuntimeError("CUDA out of memory. Tried to allocate")
        return ["y"] * len(rows)

    calls = models.Calls(f, 16)
    assert calls([(i,) for i in range(16)]) == [("y", None)] * 16
    assert sizes == [16, 8, 4, 2, 2, 2, 2, 2, 2, 2, 2]
    assert calls([(i,) for i in range(4)]) == [("y", None)] * 4 and sizes[-2:] == [2, 2]  # it is remembered
    sizes.clear()

    def fails(rows):
        sizes.append(len(rows))
        raise KeyError("no")

    calls = models.Calls(fails, 16)
    assert all(e == "KeyError: 'no'" for _, e in calls([(i,) for i in range(16)])) and sizes == [16, *[1] * 16] and calls.most == 16


def cost(batches, lengths, call):
    return sum(call + len(b) * max(lengths[i] for i in b) for b in batches)


def test_padded_batches_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 9))]
        most, budget, call = rng.choice([1, 2, 4, 9]), rng.choice([1, 20, 90, 10**6]), rng.choice([0, 3, 30])
        got = models.padded_batches(lengths, most, budget, call)
        assert sorted(itertools.chain(*got)) == list(range(len(lengths)))
        assert all(len(b) <= most and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget) for b in got)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        ways = ([order[a:b] for a, b in itertools.pairwise([0, *c, len(order)])] for n in range(len(order)) for c in itertools.combinations(range(1, len(order)), n))
        fit = (w for w in ways if all(len(b) <= most and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget) for b in w))
        assert cost(got, lengths, call) == min(cost(w, lengths, call) for w in fit)


def test_padded_cost_against_batches_of_sixteen(spark, tmp_path):
    """Counted in the model: what is padded, dealt by length and in batches by cost, against 16 rows as they come."""
    rng = random.Random(4)
    texts = [f"{i} " + "w" * int(10 ** rng.uniform(0, 4)) for i in range(1500)]

    def counting(folder):
        def f(batch):
            n = [sum(len(x["content"]) for x in m) for m in batch]
            (folder / uuid.uuid4().hex).write_text(f"{len(n)} {max(n) * len(n)} {sum(n)}")
            return echo(batch)

        return f

    prompts = models.dealt_by_length(asked(spark, texts), "messages", ["t"], splits=8)
    out = models.generate_column(prompts, "messages", Model(counting(tmp_path)))
    assert sorted(r["output"] for r in out.select("output").collect()) == sorted(texts)
    counts = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    padded, real = sum(c[1] for c in counts), sum(c[2] for c in counts)
    plain = sum(16 * max(len(t) + 1 for t in texts[i : i + 16]) for i in range(0, len(texts), 16))
    assert max(c[0] for c in counts) <= 16 and padded < 1.15 * real and padded < 0.45 * plain
    chars = [sum(len(t) for t in p) for p in prompts.select("t").rdd.mapPartitions(lambda it: [[r["t"] for r in it]]).collect()]
    assert max(chars) < 3 * sum(chars) / 8  # no split has much more than its share


def test_dealing_odd_prompts(spark):
    df = asked(spark, ["a", "b"]).unionByName(spark.createDataFrame([("n",)], "t string").withColumn("messages", F.lit(None).cast("array<struct<role: string, content: string>>")))
    assert models.dealt_by_length(df, "messages", ["t"]).count() == 3 and models.dealt_by_length(df.limit(0), "messages", ["t"]).count() == 0


def test_limits_reach_the_model(spark):
    model = Model(lambda batch, limits: [f"{m[-1]['content']} {n}" for m, n in zip(batch, limits, strict=True)], takes_limits=True)
    df = asked(spark, TEXTS).withColumn("n", F.length("t"))
    got = models.generate_column(df, "messages", model, max_tokens=F.col("n")).collect()
    assert all(r["output"] == f"{r['t']} {len(r['t'])}" for r in got)


class Counted:
    """The hashing embedder, which leaves a file for every text it sees."""

    def __init__(self, folder):
        self.folder = str(folder)

    def load(self):
        model = models.HashEmbedder(32).load()

        def run(texts):
            for t in texts:
                (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text(t)
            return model(texts)

        return run


class Never:
    def load(self):
        raise AssertionError("no model is needed")


def test_each_text_is_embedded_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    store, model = str(tmp_path / "store"), Counted(tmp_path / "seen")
    seen = lambda: sorted(p.read_text() for p in (tmp_path / "seen").iterdir())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "a b", None, "", "c d e", "c"])], "n int, t string")
    key = lambda d: sorted((r["n"], r["t"] or "", tuple(r["embedding"])) for r in d.collect())
    want = key(models.embed_column(df, "t", models.HashEmbedder(32)))
    assert key(models.embed_stored(df, "t", store, model)) == want and seen() == ["", "a b", "c", "c d e"]
    assert key(models.embed_stored(df, "t", store, Never())) == want
    more = df.unionByName(spark.createDataFrame([(9, "new one")], "n int, t string"))
    assert len(key(models.embed_stored(more, "t", store, model))) == 8 and seen() == ["", "a b", "c", "c d e", "new one"]
    assert models.embed_stored(df.limit(0), "t", store, Never()).count() == 0
    assert models.embed_stored(df.limit(0), "t", str(tmp_path / "none"), Never()).count() == 0


def test_index_with_a_store(spark, tmp_path):
    raw = spark.createDataFrame([("v", i, float(i), i + 1.0, "the same words again") for i in range(400)], "video_id string, pos int, start double, end double, text string")
    plain = sorted(map(str, flows.index_videos(raw).collect()))
    assert sorted(map(str, flows.index_videos(raw, store=str(tmp_path)).select("video_id", "chunk_id", "start", "end", "text", "word_count", "embedding").collect())) == plain
    assert flows.index_videos(raw, Never(), store=str(tmp_path)).count() == len(plain)


def test_remembered_words_are_bounded(monkeypatch):
    """A task of many distinct words: the same vectors, and no more words remembered than the bound."""
    texts = [" ".join(f"w{i}" for i in range(n, n + 50)) for n in range(0, 2000, 25)]
    want = models.HashEmbedder().load()(texts)
    monkeypatch.setattr(models, "REMEMBERED", 100)
    run = models.HashEmbedder().load()
    assert (run(texts) == want).all()
    place = next(c.cell_contents for c in run.__closure__ if callable(c.cell_contents))
    assert max(len(c.cell_contents) for c in place.__closure__ if isinstance(c.cell_contents, dict)) <= 100
