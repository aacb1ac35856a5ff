"""Summary queries read every text to its end, and return every document."""

import duckdb
import pytest
from conftest import values

from transcript_jobs import registry

LINES = [f"line {i} of a long text" for i in range(60)]
TEXTS = {k: "\n".join(LINES) for k in range(4)} | {k: "   \n  " for k in range(4, 8)} | {8: "   three blanks first", 9: "one", 10: None, 11: "x" * 500, 12: "a\nb"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, t, "en", "a", len(t or "")) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def result(spark, folder):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")

    def of(name):
        got = registry.queries()[name](spark, folder).toPandas()
        assert values(got) == values(c.sql(registry.oracle_sql()[name]).df())
        return got.set_index("doc_id")

    return of


def test_parse_summary_whole(result):
    got = result("parse_summary_whole")
    assert sorted(got.index) == sorted(TEXTS)
    assert all(got.summary[k].split("\n") == LINES for k in range(3))


def test_final_summary_whole(result):
    got = result("final_summary_whole")
    assert sorted(got.index) == sorted(TEXTS)
    assert all(got.summary[k].split("\n") == LINES for k in range(4)) and got.raw[[4, 5, 6, 7]].all() and got.summary[11] == "x" * 500


def test_salvage_lines_whole(result):
    assert result("salvage_lines_whole").n.to_dict() == {k: {0: 58, 1: 58, 2: 59}.get(k, 0) for k in TEXTS}


def test_usable_chunks_whole(result):
    assert sorted(result("usable_chunks_whole").index) == [0, 1, 2, 3, 8, 9, 11, 12]
