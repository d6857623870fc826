import duckdb
import pytest

import corpus_pipeline
from feloom.llm import queries as llm
from feloom.llm.common import cut

from .conftest import SF
from ..test_queries import TABLES, plain


@pytest.mark.parametrize("name", llm.oracle_sql())
def test_oracle(spark, name):
    df = llm.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    got = [tuple(map(plain, r)) for r in df.select(*sorted(columns)).collect()]
    assert sorted(columns) == sorted(df.columns) and sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_covers_its_table(spark, name):
    table = "pages" if "pages" in name or "html" in name else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = llm.queries()[name](spark, SF).count()
    assert got >= rows if "packing" in name else got == rows


def test_stages(spark, docs):
    """Each stage keeps the columns, and what it drops is what its operator rejects."""
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, now, SF), f"test-{name}")
        assert after.columns == columns
        assert name == "mixing" or after.join(now, "doc_id", "left_anti").count() == 0
        now = after
    assert now.count() > 0
    ids = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert ids == {r.doc_id for r in now.collect()}


def test_near_stage(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text.replace("w40", "zz"), "en", "a", 1), (4, "other", "en", "a", 1), (None, text, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()), key=str) == [1, 4, None]


def test_near_stage_takes_similarities_from_80(spark):
    """69 of 83 shingles are common: 0.83."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (2, text.replace("w40 w41 w42", "x y z"), "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near(spark, df, SF).collect()] == [1]


def test_pipeline_on_nothing(spark, nothing):
    now = nothing
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
