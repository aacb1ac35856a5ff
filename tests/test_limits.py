"""Queries with the limits of the operators, on a transcript with more question windows than the limits."""

import duckdb
import pytest
from conftest import values

from transcript_jobs import registry

NAMES = "cap_candidates_60 question_prompts_60 accept_questions_60 dedupe_questions_60 rank_questions_12 serialize_questions_60 cached_questions_60".split()
TOPICS = "rivers mountains engines violins planets bridges gardens harbors castles deserts".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Document 1 has 80 questions of different words, each amid lines that ask nothing; document 2 has two."""
    path = str(tmp_path_factory.mktemp("limits"))
    ask = lambda i: f"Which {TOPICS[i % 10]} {TOPICS[i // 10 % 10]} number{chr(97 + i % 26)}{chr(97 + i // 26)} grow every winter?"
    text = lambda n: "\n".join(f"{ask(i)}\nplain words here\nother plain words" for i in range(n))
    rows = [(1, text(80), "en", "a", 0), (2, text(2), "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_own_limits(spark, folder, name):
    got = registry.queries()[name](spark, folder).toPandas()
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert values(got) == values(c.sql(registry.oracle_sql()[name]).df())
    first = got[got.video_id == "vid00000001"]
    n = first.questions.str.count("\n").iloc[0] + 1 if name.startswith("cached") else len(first)
    if name.startswith("rank"):
        assert n == 12
    elif name.startswith(("cap", "question_prompts")):
        assert n == 60
    else:
        assert 12 < n <= 60
