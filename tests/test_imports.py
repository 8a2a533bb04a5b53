from pyspark.sql import functions as F

from hirelake.operators import imports, matching, registry, requirements, resume
from hirelake.sources import fixtures, text


def test_single_postings(spark):
    rows = [
        (1, "greenhouse", "u", "", '{"job":{"id":5,"title":"Web  Dev","location":{"name":"Remote"},"absolute_url":"http://x","content":"<p>Required:</p><p>- React and TypeScript work</p>"},"board":"acme_co"}'),
        (2, "greenhouse", "u", "", '{"id":6,"title":"Ops","content":"Text","departments":[{"name":"Core"}]}'),
        (3, "greenhouse", "http://b", "<b>All</b> jobs", '{"jobs":[]}'),
        (4, "lever", "http://l", "", '{"id":"p","text":"<div>Lead</div><div>More</div>","categories":{"location":"Oslo"}}'),
        (5, "ashby", "u", "", '{"jobs":[{"id":"a","title":"One","isRemote":true,"descriptionHtml":""}],"board":"beta"}'),
        (6, "ashby", "http://a", "several", '{"jobs":[{"id":"a"},{"id":"b"}],"companyName":"Gamma"}'),
    ]
    d = imports.single(spark.createDataFrame(rows, "id int, provider string, url string, text string, payload string"))
    got = {r["id"]: (r["company"], r["title"], r["workplace"], r["job_url"], r["source_job_id"], r["description"]) for r in d.collect()}
    assert got[1][:5] == ("Acme Co", "Web Dev", "remote", "http://x", "5") and got[2] == ("Core", "Ops", "unknown", None, "6", "Text")
    assert got[3] == ("Greenhouse Board", "Multiple Positions", None, "http://b", None, "All jobs")
    assert got[4] == ("Company", "Lead", "unknown", "http://l", "p", "Lead\nMore")
    assert got[5] == ("Beta", "One", "remote", None, "a", "One") and got[6][:2] == ("Gamma", "Multiple Positions")
    assert d.filter("id = 1").first()["required"] == ["React and TypeScript work"]


def test_every_kind_of_input(spark):
    form = '{"company":"Acme","title":"Dev","description":"Text","workplaceType":"remote","technologies":["a"]}'
    inputs = [
        (1, "https://boards.greenhouse.io/acme/jobs/5"), (2, " https://jobs.lever.co/x/1 "), (3, "https://jobs.ashbyhq.com/b/1"), (4, "https://example.com/job"), (5, "https://example.com/gone"),
        (6, form), (7, "Title: Web Dev\nCompany: Acme\nLocation: Oslo\nWork remote with React"), (8, '{"company":"","title":"Dev","description":"x","workplaceType":"remote"}'), (9, "{broken"), (10, "https://jobs.lever.co/y/2"), (11, None),
    ]
    pages = [("https://boards.greenhouse.io/acme/jobs/5", '{"job":{"id":5,"title":"Web Dev","location":{"name":"Remote"},"absolute_url":"http://x","content":"Text"},"board":"acme_co"}'), ("https://jobs.lever.co/x/1", "<html>"), ("https://example.com/job", "<title>Lead</title><p>Role: Boss</p>"), ("https://jobs.lever.co/y/2", '{"id":"p","text":"<div>Lead</div>"}')]
    d = imports.import_jobs(spark.createDataFrame(inputs, "id int, input string"), spark.createDataFrame(pages, "url string, payload string"))
    got = {r["id"]: (r["provider"], r["company"], r["title"], r["workplace"], r["error"]) for r in d.collect()}
    assert got[1] == ("greenhouse", "Acme Co", "Web Dev", "remote", None) and got[10] == ("lever", "Company", "Lead", "unknown", None)
    assert got[2][::4] == ("lever", "invalid payload") and got[3][::4] == ("ashby", "could not reach the board")
    assert got[4] == ("generic_web", "Unknown Company", "Lead", "unknown", None) and got[5][0] == "generic_web" and got[5][4] is None
    assert got[6] == ("manual", "Acme", "Dev", "remote", None) and got[7] == ("pasted_description", "Acme", "Web Dev", "remote", None)
    assert got[8][4] == "invalid: company" and got[9][::4] == ("manual", "invalid form") and len(got) == 11
    assert d.filter("id = 3").first()["message"] == imports.REACH and d.filter("id = 8").first()["message"] == imports.INVALID
    assert d.filter("id = 5").first()["description"].startswith("Failed to fetch URL: https://example.com/gone")


def test_forms_pages_and_limits(spark):
    form = '{"company":"Acme","title":"Dev","description":"Text","workplaceType":"office","technologies":["a"],"jobUrl":"nowhere"}'
    d = imports.from_form(spark.createDataFrame([(1, form)], "id int, text string"))
    r = d.withColumn("broken", imports.broken_limits(d)).first()
    assert (r["company"], r["salary_currency"], r["required"], r["technologies"], r["broken"]) == ("Acme", "CAD", [], ["a"], ["workplace", "job_url"])
    pages = spark.createDataFrame([(1, "Lead role\nBody", "Real Title"), (2, "Lead", None)], "id int, text string, page_title string")
    assert {r["id"]: r["title"] for r in imports.from_page(pages).collect()} == {1: "Real Title", 2: "Lead"}
    many = imports.with_defaults(d.select("company", "title", "workplace", F.lit("x" * 50_001).alias("description"), F.array_repeat(F.lit("t"), 51).alias("technologies")))
    assert many.select(imports.broken_limits(many, confirmed=True).alias("b")).first()["b"] == ["workplace", "description", "technologies"]


def test_blocks_are_filled_from_their_lines(spark):
    rows = [
        (1, None, None, None, ["Senior Engineer", "Jun 2020 - Present", "Acme Inc", "- did it"]),
        (2, None, "Jun 2020 - Present", None, []),
        (3, "Web Developer", None, None, []),
        (4, None, "Acme Inc", "2020", []),
        (5, "Product Manager", "Jun 2020 - Present", None, []),
    ]
    d = resume.enriched(spark.createDataFrame(rows, "id int, company string, title string, date_text string, lines array<string>"))
    got = {r["id"]: (r["company"], r["title"], r["date_text"]) for r in d.collect()}
    assert got == {1: ("Acme Inc", "Senior Engineer", "Jun 2020 - Present"), 2: (None, None, "Jun 2020 - Present"), 3: (None, "Web Developer", None), 4: ("Acme Inc", None, "2020"), 5: (None, "Product Manager", "Jun 2020 - Present")}


def test_discovery_sources(spark):
    rows = [(1, '[{"companyName":"A","boardSlug":"a"},{"companyName":"none"}]'), (2, '{"candidates":[{"boardUrl":"u","discoverySource":"s"}]}'), (3, "{}")]
    d = spark.createDataFrame(rows, "id int, p string").select("id", F.explode(text.candidates(F.col("p"), F.lit("f.json"))).alias("c")).select("id", "c.*")
    assert [(r["id"], r["name"], r["slug"], r["url"], r["source"]) for r in d.orderBy("id").collect()] == [(1, "A", "a", None, "import:f.json"), (2, None, None, "u", "s")]
    seed = spark.createDataFrame([('{"companies":[{"companyName":"B","country":"CA","tags":["x"]}]}',)], "p string").select(F.explode(text.candidates(F.col("p"), F.lit(""), seed=True)).alias("c")).select("c.*").first()
    assert (seed["name"], seed["country"], seed["industries"], seed["source"]) == ("B", "CA", ["x"], "existing-seed")
    assert text.with_fallback(d.limit(0), d).count() == 2 and text.with_fallback(d.limit(1), d).count() == 1


def test_warnings_are_merged_once(spark):
    w = "array(named_struct('code', 'a', 'field', 'f', 'message', 'm'), named_struct('code', 'b', 'field', 'f', 'message', 'm'))"
    assert len(spark.range(1).select(resume.merged_warnings(F.expr(w), F.expr(w)).alias("w")).first()["w"]) == 2


def test_json_posting_against_json_profile(spark):
    post = '{"id":"1","title":"Senior Frontend Engineer","location":"Remote","workplaceType":"remote","description":"d","requiredQualifications":["React experience"],"technologies":["react","aws"]}'
    person = '{"yearsExperience":7,"remotePreference":"remote","skills":[{"name":"React"}],"evidence":[{"evidenceText":"Built React apps","normalizedSkills":["react"]}]}'
    d = fixtures.job_posts(spark.createDataFrame([(post,)], "payload string")).withColumn("profile", fixtures.seed_profile(F.lit(person)))
    r = matching.analyse(requirements.structured(d)).first()
    assert (r["matches"][0]["status"], r["matches"][0]["evidence_id"], r["top_skills"], r["filter"]["result"]) == ("confirmed", "evidence-0", ["react"], "pass")
    assert r["overall"] <= 55  # one required gap


def test_names_are_sorted_as_people_do(spark):
    d = spark.createDataFrame([(1, "zeta"), (2, "Émile"), (3, "emil"), (4, "Alpha"), (5, "alpha")], "id int, name string")
    assert [r["id"] for r in registry.by_name(d).collect()] == [5, 4, 3, 2, 1]


def test_a_long_page_is_cut_and_no_more(spark):
    """The cut text of a page is not trimmed or decoded anew, and pages of one id stay one posting each."""
    texts = ["x" * 49_999 + " and more", "a &amp; <b>", "a &amp; <b>"]
    pages = spark.createDataFrame([(i and 1, t, None) for i, t in enumerate(texts)], "id int, text string, page_title string")
    got = sorted((r["id"], r["description"]) for r in imports.from_page(pages).collect())
    assert got == [(0, "x" * 49_999 + " "), (1, "a &amp; <b>"), (1, "a &amp; <b>")]
