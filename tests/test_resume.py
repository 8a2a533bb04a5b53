"""Resume lines, sections, blocks and scores."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import options
from hirelake.functions import resume_lines as rl
from hirelake.operators import resume, tailoring


def col(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_line_kinds(spark):
    assert col(spark, rl.is_date_range, "Jun 2022 - Present", "06/2022 – 12/2023", "Built 3 apps", None) == [True, True, False, False]
    assert col(spark, rl.is_job_title, "Senior Frontend Engineer", "Acme Inc", "x" * 81 + " engineer") == [True, False, False]
    assert col(spark, rl.is_company, "Acme Inc", "Frontend Developer", "A sentence.", "A") == [True, False, False, False]
    assert col(spark, rl.is_achievement, "Led the migration", "Acme Inc") == [True, False]
    assert col(spark, rl.heading, " Work Experience ", "Education", "My education") == ["experience", "education", None]
    assert col(spark, rl.is_contact_or_header, "a@b.co", "+1 416 555 0100", "skills", "2019 - present", "Built things") == [True, True, True, True, False]


def test_date_run_into_a_title(spark):
    assert col(spark, rl.split_date_title, "06/2022 - presentDeveloper", "Jan 2020 - 2021Web Engineer", "plain") == [["06/2022 - present", "Developer"], ["Jan 2020 - 2021", "Web Engineer"], ["plain"]]


def test_bullets(spark):
    lines = F.array(*(F.lit(x) for x in ("- Built a design system for teams", "* short", "a@b.co", "No verb here but more than forty characters long")))
    assert spark.range(1).select(rl.kept_bullets(lines)).first()[0] == ["Built a design system for teams", "No verb here but more than forty characters long"]
    assert col(spark, rl.is_tailorable, "Led a team of 5 across 3 offices", "Jane Doe | Engineer | Toronto, Canada", "short", "mail me at someone@example.com for this") == [True, False, False, False]


def test_tailoring(spark):
    bullets = spark.createDataFrame([("u", 1, "Built React dashboards used by 40% of clients"), ("u", 2, "Maintained build servers and release tooling"), ("u", 3, "x")], "user string, pos int, text string")
    jobs = spark.createDataFrame([("j", "u", "React dashboards for clients")], "job string, user string, description string")
    assert [(r["rank"], r["pos"], r["points"]) for r in resume.tailoring_bullets(bullets, jobs).orderBy("rank").collect()] == [(1, 1, 6), (2, 2, 2)]


def test_claims(spark):
    d = spark.range(1).select(rl.unsupported_claims(F.lit("I have 9 years of experience. I led the React rewrite."), F.lit("Led the React rewrite"), F.lit("React and AWS")).alias("c"))
    assert d.first()["c"] == ['Verify claim: "9 years of experience"']


def test_sections_and_blocks(spark):
    text = ["Jane Doe", "Web person", "jane@example.com", "Toronto, Canada", "Experience", "Senior Engineer | Acme", "Jun 2020 - Present", "- Built a design system for teams", "Skills", "Languages: TypeScript, Go", "Docker", "Tools:", "Figma, Jira"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line_no int, text string")
    s = resume.sections(lines)
    c = resume.lines_of(s, "contact").select(resume.contact(F.col("lines")).alias("c")).first()["c"]
    assert (c["full_name"], c["headline"], c["email"], c["location"]) == ("Jane Doe", "Web person", "jane@example.com", "Toronto, Canada")
    g = resume.skill_groups(s.filter("section = 'skills'")).orderBy("group_no").collect()
    assert [(r["category"], r["skills"]) for r in g] == [("Languages", ["TypeScript", "Go", "Docker"]), ("Tools", ["Figma", "Jira"])]
    b = resume.reconciled(resume.experience_blocks(s.filter("section = 'experience'"))).collect()
    assert [(r["title"], r["company"], r["dates"]["start"], r["dates"]["current"], r["bullets"]) for r in b] == [("Senior Engineer", "Acme", "2020-06", True, ["Built a design system for teams"])]


def test_swapped_title_and_dates(spark):
    d = spark.createDataFrame([("d", 0, "Jun 2020 - 2022", "Web Developer", None)], "doc string, block_no int, title string, company string, date_text string")
    r = resume.reconciled(d).first()
    assert (r["title"], r["company"], r["dates"]["start"], r["dates"]["end"]) == ("Web Developer", None, "2020-06", "2022-01")


def test_layout(spark):
    items = [("d", 1, "Jane", 0.0, 700.0, 20.0), ("d", 1, "Doe", 40.0, 699.0, 20.0), ("d", 1, "Page 1 of 2", 0.0, 10.0, 50.0), ("d", 1, "Acme", 0.0, 650.0, 20.0), ("d", 1, "Jane D.", 0.0, 20.0, 9.0), ("d", 2, "Jane D.", 0.0, 20.0, 9.0), ("d", 2, "12", 0.0, 5.0, 5.0)]
    d = resume.without_repeats(spark.createDataFrame(items, "doc string, page int, text string, x double, y double, width double"))
    assert [r["text"] for r in resume.group_lines(d).orderBy("line_no").collect()] == ["Jane Doe", "Acme"]


def test_confidence(spark):
    c = resume.confidence(F.lit(4), F.lit(True), F.lit(20), F.array(F.lit(2), F.lit(0)), F.lit(True), F.lit(False), F.lit(1))
    r = spark.range(1).select(c.alias("c")).first()["c"]
    assert (r["contact"], r["summary"], r["skills"], r["education"], r["certifications"]) == (1.0, 0.8, 1.0, 0.7, 0.3)
    assert r["experience"] == pytest.approx(0.7) and 0 < r["overall"] < 1


def test_options(spark):
    assert col(spark, options.work_authorization, "Canadian Citizen", "US work authorized", "x", None) == ["canadian_citizen", "us_authorized", "", ""]
    assert col(spark, options.seniority, "Principal", "senior dev", "mid-level") == ["staff", "senior", "mid"]
    assert col(spark, options.remote_preference, "Remote only", "Onsite") == ["remote", "on_site"]


def test_tailoring_pairs_jobs_with_kinds_of_bullets(spark):
    """Points of every pair, by brute force; and a job meets a kind of bullet once, however many bullets it has."""
    texts = ["Built React dashboards used by 40% of clients", "Dashboards used by clients: built 40% with React", "Maintained build servers and release tooling", "Wrote long documents about many things and places", "x"]
    bullets = spark.range(400).select((F.col("id") % 2).alias("user"), F.col("id").alias("pos"), F.get(F.array(*map(F.lit, texts)), (F.col("id") * 7 % 5).cast("int")).alias("text"))
    wanted = ["React dashboards for clients", "Release tooling", "documents and places", "", None]
    jobs = spark.createDataFrame([(i, i % 2, wanted[i % 5]) for i in range(20)], "job long, user long, description string")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) > 3))
    pairs = jobs.join(bullets.filter(rl.is_tailorable(F.col("text"))), "user")
    hits = F.coalesce(F.size(F.filter(words, lambda w: F.contains(F.lower("description"), w))), F.lit(0))
    pairs = pairs.withColumn("points", hits + F.when(F.col("text").rlike("(?i)built|maintained"), 2).otherwise(0) + F.when(F.col("text").contains("%"), 1).otherwise(0))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["job"], -r["points"], r["pos"])):
        want.setdefault(r["job"], []).append((r["pos"], r["points"], r["text"]))
    found = resume.tailoring_bullets(bullets, jobs)
    got = {}
    for r in found.orderBy("job", "rank").collect():
        got.setdefault(r["job"], []).append((r["pos"], r["points"], r["text"]))
    assert got == {k: v[:8] for k, v in want.items()} and len(got) == 20


def test_evidence_of_a_candidate_meets_what_it_fits(spark):
    bullets = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 6, "b"), (2, 0, 6, "b"), (3, 1, 6, None)], "job int, user int, id int, text string")
    evidence = spark.createDataFrame([(0, 10, 5, "z"), (0, 11, 6, "a"), (0, 12, None, "b"), (0, 13, 7, "c"), (1, 14, None, None), (1, 15, 6, "q")], "user int, id int, source_id int, text string")
    found = tailoring.linked_evidence(evidence, bullets, "user")
    assert sorted((r["job"], r["id"]) for r in found.collect()) == [(1, 10), (1, 11), (1, 12), (2, 11), (2, 12), (3, 15)]
    by_job = bullets.select("job", "user").distinct().join(evidence, "user").drop("user")
    same = tailoring.linked_evidence(by_job, bullets.drop("user"))
    assert sorted((r["job"], r["id"]) for r in same.collect()) == sorted((r["job"], r["id"]) for r in found.collect())


def test_jobs_are_not_broadcast(spark):
    """Jobs grow with the table, however small a frame made of their keys is taken to be."""
    jobs = spark.range(1000).select(F.col("id").alias("job"), F.lit("React and GraphQL").alias("description"))
    ranked = jobs.select("job", F.lit(1).alias("rank"), F.lit("b").alias("id"), F.lit("Built React apps").alias("text"))
    found = tailoring.suggestions(ranked, jobs)
    assert {(r["suggested"], float(r["confidence"])) for r in found.collect()} == {("Built React apps (Emphasize for role: react)", 0.55)} and found.count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_all_evidence_of_all_jobs_takes_little_disk(spark, tmp_path):
    """A product of jobs and evidence, larger than a block both ways, is whole and is written as runs."""
    n_jobs, n_said = 4200, 1100
    one = lambda x: F.when(F.col("id") >= 0, x)  # noqa: E731  not known as a constant
    bullets = spark.range(n_jobs).select((F.col("id") * 7919 % 100_003).alias("job"), one(1).alias("user"), one(-1).alias("id"), one("a").alias("text"))
    said = spark.range(n_said).select(one(1).alias("user"), (F.col("id") * 104_729 % 1_000_003).alias("id"), F.lit(None).cast("int").alias("source_id"), one("a").alias("text"))
    odd = spark.createDataFrame([(1, 5, None, None), (None, 6, None, "a"), (2, 7, None, "a"), (1, 8, None, "b"), (1, 9, -1, None)], "user int, id long, source_id int, text string")
    found = tailoring.linked_evidence(said.unionByName(odd), bullets, "user").select("job", "id")
    found.write.parquet(str(tmp_path / "found"))
    d = spark.read.parquet(str(tmp_path / "found"))
    total = said.agg(F.sum("id")).first()[0]
    of_a_job = d.groupBy("job").agg(F.count("id").alias("n"), F.count_distinct("id").alias("different"), F.sum("id").alias("total")).groupBy("n", "different", "total").count().collect()
    assert [tuple(r) for r in of_a_job] == [(n_said + 1, n_said + 1, total + 9, n_jobs)]
    assert sum(p.stat().st_size for p in (tmp_path / "found").glob("*.parquet")) < 0.3 * n_jobs * n_said
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
