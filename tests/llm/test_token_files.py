"""Token files: exact ids, order and places against the tokenizer; indexes, Bloom filters and pruning against the files themselves."""

import glob
import zlib

import numpy as np
import pyarrow.orc
import pytest
from conftest import SF
from pyspark.sql import functions as F

from transcript_jobs.llm import packing
from transcript_jobs.llm import token_files as T

LONG = " ".join(f"word{i % 997} is{i}." for i in range(30_000))
ODD = [(5, LONG), (2, None), (None, "no key"), (3, ""), (7, "twice"), (7, "twice"), (7, "thrice, but other"), (None, "no key"), (-1, "😀 é <|endoftext|>  two  spaces\x0b"), (4, "  \n\t ")]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(got, docs, encode):
    """Rows (doc_id, start, n_tokens, crc) are those of the documents, gapless, in ascending order of keys, nulls first."""
    got = sorted(got, key=lambda r: r[1])
    at = 0
    for k, start, n, _ in got:
        assert start == at
        at += n
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert sorted((str(k), n, c) for k, _, n, c in got) == sorted((str(k), len(encode(t)), crc(encode(t))) for k, t in docs)


def rows_of(spark, path):
    return [tuple(r) for r in T.with_crc32(T.with_start(T.read_tokens(spark, path))).collect()]


@pytest.mark.parametrize("file_bytes", [1 << 30, 20_000])
def test_odd_texts(spark, tmp_path, encode, file_bytes):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in "h s t part at ids n_tokens start _x0 Text DOC_ID".split()])
    T.write_tokens(df, f"{tmp_path}/t", file_bytes=file_bytes)
    check(rows_of(spark, f"{tmp_path}/t"), ODD, encode)


def test_rows_of_one_key_are_spread(spark, tmp_path, encode):
    docs = [(1, f"text {i} " * 20) for i in range(300)] + [(1, "the same")] * 200 + [(2, "last")]
    T.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/t", file_bytes=5000)
    check(rows_of(spark, f"{tmp_path}/t"), docs, encode)
    sizes = [r["count"] for r in T.read_tokens(spark, f"{tmp_path}/t").filter("doc_id = 1").groupBy("part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 150


def test_empty_table_and_text_keys(spark, tmp_path, encode):
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert rows_of(spark, f"{tmp_path}/e") == []
    docs = [(f"k{i:03}", f"text {i}") for i in range(50)]
    T.write_tokens(spark.createDataFrame(docs, "name string, body string"), f"{tmp_path}/s", key="name", text="body")
    check(rows_of(spark, f"{tmp_path}/s"), docs, encode)


def test_query(spark, encode):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check([tuple(r) for r in T.query(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()], docs, encode)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Files of 40,000 documents with even keys, in several stripes each."""
    path = f"{tmp_path_factory.mktemp('orc')}/t"
    docs = spark.range(40_000).selectExpr("id * 2 AS doc_id", "repeat(concat('word ', id, ' of a text. '), 5) AS text")
    T.write_tokens(docs, path, stripe_bytes=100_000, stride_rows=1000)
    return path


def test_other_readers_and_stripes(files, encode):
    """The files are ORC to another library too; several stripes each, which can be read apart."""
    own = [pyarrow.orc.ORCFile(f) for f in sorted(glob.glob(f"{files}/*.orc"))]
    assert sum(f.nrows for f in own) == 40_000 and max(f.nstripes for f in own) > 1 and {f.row_index_stride for f in own} == {1000}
    f = max(own, key=lambda f: f.nstripes)
    whole, parts = f.read(["doc_id", "ids"]).to_pylist(), [r for i in range(f.nstripes) for r in f.read_stripe(i, ["doc_id", "ids"]).to_pylist()]
    assert whole == parts
    for r in whole[:20]:
        assert r["ids"] == encode(f"word {r['doc_id'] // 2} of a text. " * 5)


def test_bloom_filters_and_indexes_are_stored(spark, files):
    reader = spark._jvm.org.apache.orc.OrcFile
    name = sorted(glob.glob(f"{files}/*.orc"))[0]
    conf = spark._jsc.hadoopConfiguration()
    orc = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{name}"), reader.readerOptions(conf))
    rows = orc.rows()
    footer = rows.readStripeFooter(orc.getStripes().get(0))
    streams = [(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()]
    rows.close()
    assert ("BLOOM_FILTER_UTF8", 1) in streams and ("ROW_INDEX", 1) in streams
    kinds = [e.getKind().toString() for e in footer.getColumnsList()]
    assert kinds[1] == "DIRECT_V2" and kinds[-1] == "DIRECT_V2"  # run lengths, second version


def test_lookup_reads_few_rows(spark, files):
    """A key that is there costs a row group, one between two keys costs none but by a filter's rare mistake."""

    def looked_at(key):
        df = T.read_tokens(spark, files).filter(F.col("doc_id") == key)
        plan = df._jdf.queryExecution().executedPlan()
        leaf, found = plan.collectLeaves().apply(0), len(plan.executeCollectPublic())
        return found, leaf.metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        there, missing = [looked_at(2 * k) for k in (3, 17_777, 39_999)], [looked_at(2 * k + 1) for k in range(1000, 39_000, 3800)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all(found == 1 and read <= 3000 for found, read in there)
    assert all(found == 0 for found, _ in missing) and sum(read for _, read in missing) <= 3000
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in T.read_tokens(spark, files).filter("doc_id = 6")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
