"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from hirelake.operators import incremental
from hirelake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["category_scores", "pasted_postings", "resume_sections", "match_summary", "resume_blocks", "resume_skills", "resume_contact", "section_carry", "location_class"])
def test_texts_made_of_a_small_file_are_spread(spark, name):
    """A file of keys is one task; what is made of them is dealt to many, by an exchange of keys only."""
    df = catalog.QUERIES[name](spark, DATA)
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_repeated_lines_without_a_join(spark):
    """A document of several rows is one document; documents and sources may be null. No join, so no line that all have is one task."""
    docs = [(1, "a", "x\n x\n\ny"), (1, "a", "y\nz"), (2, "a", "z\n\n"), (None, "a", "z\nq"), (3, None, "x\nx"), (4, None, "x"), (5, "b", " \n"), (6, "b", None), (7, "b", "x")]
    found = incremental.kept_lines(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    assert {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in found.collect()} == {1: (5, 4), 2: (1, 0), None: (2, 1), 3: (2, 2), 4: (1, 1), 7: (1, 1)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
