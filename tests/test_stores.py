import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import coercion, parse_cache, registry, verification
from hirelake.sources import policies


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_cache_stays_where_it_lies(spark, tmp_path):
    cache = parse_cache.ParseCache(spark, "parses_of_test", str(tmp_path / "cache"), 4)
    old = [("u1", "h1", "v1", 1, "first"), ("u1", "h1", "v1", 2, "second"), ("u2", "h1", "v1", 1, "other"), ("u1", "h2", "v2", 1, "new")]
    kind = "user string, hash string, version string, created long, parsed string"
    cache.add(spark.createDataFrame(old[:2], kind))
    cache.add(spark.createDataFrame(old[2:], kind))
    docs = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u3", "h1"), (4, "u1", "h2"), (5, None, "h1")], "id int, user string, hash string")
    got = lambda v: {r["id"]: r["parsed"] for r in cache.look_up(docs, v).collect()}
    assert got("v1") == {1: "second", 2: "other", 3: None, 4: None, 5: None} and got("v2") == {1: None, 2: None, 3: None, 4: "new", 5: None}
    plan = executed(cache.look_up(docs, "v1")).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan  # the documents move, the table has its buckets
    spark.sql("DROP TABLE parses_of_test")


def test_policies(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, user_id string")
    matches = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 99)], "id int, job_id int")
    notes = spark.createDataFrame([(100, 10), (101, 11), (102, None)], "id int, match_id int")
    tables = {"jobs": jobs, "matches": matches, "notes": notes, "companies": spark.range(4), "secrets": spark.range(2)}
    rules = policies.Policies().owned("jobs").through("matches", "job_id", "jobs").through("notes", "match_id", "matches").open("companies")
    rules.install(spark, tables)
    ids = lambda t: sorted(r["id"] for r in spark.table(t).collect())
    want = {"a": ([1], [10], [100]), "b": ([2], [11], [101]), "c": ([], [], []), None: ([], [], [])}
    for user, seen in want.items():
        with policies.as_user(spark, user):
            assert (ids("jobs"), ids("matches"), ids("notes")) == seen and ids("companies") == [0, 1, 2, 3]
            assert spark.sql("SELECT count(*) FROM jobs JOIN matches ON job_id = jobs.id").first()[0] == len(seen[1])
            # no read of a registered table escapes: with the owner's predicate negated nothing is left
            assert spark.sql("SELECT * FROM jobs WHERE user_id IS DISTINCT FROM session.row_user").count() == 0
            assert sorted(r["id"] for r in rules.refused(spark, "jobs", jobs).collect()) == [i for i in (1, 2, 3) if i not in seen[0]]
            assert sorted(r["id"] for r in rules.refused(spark, "matches", matches).collect()) == [i for i in (10, 11, 12, 13) if i not in seen[1]]
            assert rules.refused(spark, "companies", spark.range(2)).count() == 2
    with policies.as_user(spark, "a"):
        of_a = spark.table("jobs")
        with policies.as_user(spark, "b"):
            assert [r["id"] for r in of_a.collect()] == [1]
    assert not spark.catalog.tableExists("secrets") and ids("jobs") == []
    with pytest.raises(ValueError):
        policies.Policies().through("matches", "job_id", "jobs")


def test_coercion(spark):
    texts = ['{"displayName": "A", "skills": ["x", {"name": "y", "category": "z"}, 3, {"name": null}], "experiences": [{"company": " B ", "endDate": "present", "bullets": ["c", 1]}, "d"], "targetTitles": "t"}', "[1]", "oops", None, '{"skills": {}, "targetTitles": [null, "u"], "summary": 4}', "{}"]
    d = coercion.coerced(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    rows = {r["id"]: r for r in d.collect()}
    assert rows[0]["errors"] == ["skills[2]", "skills[3].name", "experiences[0].bullets[]", "experiences[1]"]
    assert [tuple(s) for s in rows[0]["skills"]] == [("x", None), ("y", "z")] and rows[0]["target_titles"] == ["t"]
    assert all(rows[i]["errors"] == ["$"] and rows[i]["skills"] == [] and rows[i]["display_name"] is None for i in (1, 2, 3))
    assert rows[4]["errors"] == ["summary", "skills", "targetTitles[0]"] and rows[4]["target_titles"] == ["u"] and rows[5]["errors"] == []
    r = coercion.as_resume(coercion.sanitised(d)).filter("id = 0").first()
    assert r["experience"][0]["company"] == "B" and r["experience"][0]["current"] and r["skill_groups"][0]["skills"] == ["x", "y"]


def test_slots(spark):
    rnd = random.Random(1)
    boards = [(f"b{i:04}", rnd.choice(["greenhouse", "lever", "lever", "ashby", "other"])) for i in range(700)]
    done = [b for b, _ in boards[::9]]
    d = verification.schedule(spark.createDataFrame(boards, "id string, provider string").repartition(7), spark.createDataFrame([(b,) for b in done], "id string"))
    want = []
    for p, (n, ms) in verification.RATES.items():
        want += [(b, p, i // n, i // n * ms) for i, b in enumerate(sorted(b for b, q in boards if q == p and b not in done))]
    assert sorted(tuple(r) for r in d.collect()) == sorted(want)


def test_rows_of_a_hot_key_can_be_split(spark):
    d = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.rpad(F.lit("x"), 200, "x").alias("text")).repartition(8)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = registry.duplicate_rows(d, F.col("k"))
        assert "skew" in executed(out).split("== Initial Plan ==")[0] and out.count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_helpers(spark):
    import datetime as dt

    from hirelake.functions import dates
    from hirelake.operators import resume, tailoring

    d = spark.createDataFrame([("Sept. 2020",), ("June",), ("DEC.",), (None,)], "t string")
    assert [r[0] for r in d.select(dates.month_key(F.col("t"))).collect()] == ["sept", "jun", "dec", None]
    now = dt.datetime(2024, 1, 2, 12)
    d = spark.createDataFrame([(now - dt.timedelta(hours=h),) for h in (1, 24, 25)] + [(None,)], "at timestamp")
    assert [r[0] for r in d.select(dates.is_new(F.col("at"), F.lit(now))).collect()] == [True, False, False, False]
    d = spark.createDataFrame([("é", None)], "a string, b int")
    assert d.select(registry.payload_bytes("a", "b")).first()[0] == len('{"a":"é","b":null}'.encode())
    parts = spark.createDataFrame([(1, 2, "skills", "Skills", ["Go"]), (1, 1, "contact", None, ["Ada", "x@y.z"])], "doc int, section_no int, section string, heading string, lines array<string>")
    assert resume.outlines(parts).first()["outline"] == "[contact] \nAda\nx@y.z\n\n[skills] Skills\nGo"
    entries = spark.createDataFrame([("b", "beta", True, "verified"), ("a", "Alpha", True, "verified"), ("c", "C", False, "verified"), ("d", "D", True, "empty")], "id string, name string, enabled boolean, status string")
    assert [r["id"] for r in registry.verified_catalog(entries).collect()] == ["a", "b"]
    jobs = spark.createDataFrame([(1, "We use React and GraphQL"), (2, None)], "job int, description string")
    ranked = spark.createDataFrame([(1, 1, "x", "Built React apps"), (1, 2, "y", "Wrote documents"), (2, 1, "z", "Built React apps"), (1, 6, "w", "React")], "job int, rank int, id string, text string")
    got = {r["bullet_id"]: (r["suggested"], float(r["confidence"])) for r in tailoring.suggestions(ranked, jobs).collect()}
    assert set(got) == {"x", "y"} and got["x"][0].startswith("Built React apps (Emphasize for role: ") and got["x"][1] == 0.55 and got["y"][1] == 0.4


def test_fields_that_hold_what_is_not_theirs(spark):
    from hirelake.functions.resume_lines import experience_issues

    rows = [("Engineer", "Acme"), ("Engineer Jan 2020 - Present", "Acme"), ("Lead", "Acme Mar 2019 - Apr 2020"), (None, "Senior Software Engineer"), ("01/2020 - 02/2021", "Web Developer 2019"), (None, None)]
    d = spark.createDataFrame(rows, "title string, company string").select(experience_issues(F.col("title"), F.col("company")).alias("i"))
    assert [r["i"] for r in d.collect()] == [[], ["title_has_dates"], ["company_has_dates"], ["company_has_title"], ["title_has_dates", "company_has_title"], []]
