"""The tree of a posting: what its rows become, and how often they move."""

from hirelake.operators import views
from hirelake.plans import view_catalog

DATA = "/root/testdata/sf0.001"


def test_job_tree_on_odd_rows(spark):
    """Matches without requirement, evidence or analysis, analyses without matches, rows of no posting, ids of null."""
    jobs = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, None, "c"), (4, 7, "d")], "id int, company_id int, title string")
    companies = spark.createDataFrame([(7, "Acme")], "id int, name string")
    requirements = spark.createDataFrame([(11, 1, 2, "two"), (10, 1, 1, "one"), (20, 2, 1, "own"), (None, 1, 3, "no id"), (90, 9, 1, "gone")], "id int, job_id int, pos int, text string")
    analyses = spark.createDataFrame([(100, 1, 5), (101, 1, 6), (102, 1, 6), (200, 2, 1), (None, None, 1)], "id int, job_id int, created int")
    rows = [(1, 100, 2, 10, 50), (1, 100, 1, 11, None), (1, 101, 1, 12, 50), (1, 101, 2, None, 59), (1, 100, 3, 10, 51), (1, 199, 1, 10, 50), (1, None, 1, 10, 50), (2, 200, 1, 20, 51), (None, None, 1, None, None)]
    matches = spark.createDataFrame(rows, "job_id int, analysis_id int, pos int, requirement_id int, evidence_id int")
    evidence = spark.createDataFrame([(50, "x"), (51, "y")], "id int, text string")
    d = views.job_tree(jobs, companies, requirements, analyses, matches, evidence)
    assert d.columns == ["id", "company_id", "title", "company", "requirements", "analyses"]
    text = lambda x: x and x["text"]
    got = {
        r["id"]: (
            r["company"] and r["company"]["name"],
            r["requirements"] and [(x["id"], x["text"]) for x in r["requirements"]],
            r["analyses"] and [(x["id"], x["matches"] and [(m["pos"], text(m["requirement"]), text(m["evidence"])) for m in x["matches"]]) for x in r["analyses"]],
        )
        for r in d.collect()
    }
    assert got == {
        1: ("Acme", [(10, "one"), (11, "two"), (None, "no id")], [(102, None), (101, [(1, None, "x"), (2, None, None)]), (100, [(1, "two", None), (2, "one", "x"), (3, "one", "y")])]),
        2: (None, [(20, "own")], [(200, [(1, "own", "y")])]),
        3: (None, None, None),
        4: ("Acme", None, None),
    }


def test_rows_of_a_posting_move_once(spark):
    """lineitem goes by part, by supplier and once for each kind of rows by posting (it went by requirement and analysis too)."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as at sizes where no table is broadcast
    try:
        d = view_catalog.job_detail_tree(spark, DATA)
        d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    moved = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sorted(moved) == ["company_id", "company_id", "evidence_id", "evidence_id", "id", "job_id", "job_id", "job_id", "l_partkey", "p_partkey"]
