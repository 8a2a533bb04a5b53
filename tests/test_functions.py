"""Scalar functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import dates, signals, skills, text, urls
from hirelake.operators import boards, feed, incremental, matching, registry


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.range(1).select(*(F.lit(v).alias(n) for v, n in zip(values, names))).select(col(*(F.col(n) for n in names))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("<p>a</p><p>b</p>", "a\n\nb"), ("x<br/>y", "x\ny"), ("<ul><li>one</li><li>two</li></ul>", "• one\n• two"), ("<script>x<y</script>a &lt;b&gt;", "a <b>"), ("", "")],
)
def test_html_to_text(spark, raw, want):
    assert one(spark, text.html_to_text, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<meta property='og:title' content='Senior &amp; Co'><title>x</title>", "Senior & Co"),
        ("<title> Web Engineer | Acme </title>", "Web Engineer"),
        ("<title>Front-end</title>", "Front"),
        ("<h1>Lead <b>Dev</b></h1>", "Lead Dev"),
        ("nothing", None),
    ],
)
def test_html_title(spark, raw, want):
    assert one(spark, text.html_title, raw) == want


def test_titles(spark):
    assert one(spark, text.clean_title, "  A \n B ") == "A B"
    assert one(spark, text.clean_title, "x" * 121) == "Untitled Role"
    assert one(spark, text.display_title, "", "short\nA line that is long enough") == "A line that is long enough"
    assert one(spark, text.collapse_blanks, " a \t b ") == "a b"
    assert one(spark, text.normalize_unicode, "ﬁne – “q”") == 'fine - "q"'


def test_rounding(spark):
    assert one(spark, text.round_tenth, -2.25) == -2.2
    assert one(spark, text.round_share, 1.7) == 1.0
    assert one(spark, dates.int_or_null, " 12.9 ") == 12
    assert one(spark, dates.int_or_null, "x") is None


def test_skills(spark):
    assert one(spark, skills.canonical_skill, " K8S ") == "kubernetes"
    assert one(spark, skills.technologies, "JavaScript and Next.js") == ["javascript", "next.js", "java"]


def test_urls(spark):
    assert one(spark, urls.slugify, " Acme, Inc. ") == "acme-inc"
    assert one(spark, urls.registry_id, "lever", "Ac.me") == "lever-ac-me"
    assert one(spark, urls.name_from_slug, "acme_robotics-3") == "Acme Robotics 3"
    for slug, ok in (("acme", True), ("1234", False), ("internet", False), ("ab", False), ("deadbeef00", False), ("a b", False)):
        assert one(spark, urls.is_plausible_slug, slug) is ok


@pytest.mark.parametrize(
    "place, text_, work, want",
    [
        ("Toronto", "", "remote", "remote-canada"),
        ("Remote", "US only", "unknown", "remote-us"),
        ("Remote", "EMEA team", "unknown", "remote-region-specific"),
        ("Anywhere", "work from anywhere", "unknown", "remote-unknown"),
        ("Berlin", "", "hybrid", "hybrid"),
        ("Montréal", "", "on_site", "onsite"),
        ("Paris", "", "unknown", "unknown"),
    ],
)
def test_location_class(spark, place, text_, work, want):
    assert one(spark, signals.location_class, place, text_, work) == want


def test_import_filter(spark):
    rows = spark.createDataFrame([("Frontend Engineer", "Toronto", "x", "unknown"), ("Account Executive", "Toronto", "x", "remote"), ("Engineer", "Paris", "x", "on_site"), ("Internal Tools Engineer", "Remote", "x", "unknown")], "t string, l string, d string, w string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in rows.select(signals.import_reason(F.col("t"), F.col("l"), F.col("d"), F.col("w"), none, none)).collect()]
    assert got == [None, "title_mismatch", "location_mismatch", None]


def test_boards(spark):
    raw = spark.createDataFrame(
        [
            ("greenhouse", "u", '{"board":"acme_labs","jobs":[{"id":7,"title":"Web  Engineer","location":{"name":"Remote - Canada"},"absolute_url":"http://x","content":"<p>Hi &amp; bye</p>","updated_at":"2024-01-01"}]}'),
            ("lever", "https://jobs.lever.co/beta-co", '[{"id":"p1","text":"<div>Designer</div><div>More</div>","hostedUrl":"http://y","categories":{"location":"Oslo"},"createdAt":1700000000000}]'),
            ("ashby", "u", '{"companyName":"Gamma","jobs":[{"id":"a","title":"Ops","isRemote":false,"workplaceType":"OnSite","location":"Rome","descriptionHtml":""}]}'),
            ("other", "u", "{}"),
        ],
        "provider string, url string, payload string",
    )
    got = {r["provider"]: r for r in boards.normalize(raw).collect()}
    assert set(got) == {"greenhouse", "lever", "ashby"}
    assert (got["greenhouse"]["company"], got["greenhouse"]["title"], got["greenhouse"]["workplace"], got["greenhouse"]["description"], got["greenhouse"]["source_job_id"]) == ("Acme Labs", "Web Engineer", "remote", "Hi & bye", "7")
    assert (got["lever"]["company"], got["lever"]["title"], got["lever"]["date_posted"]) == ("Beta Co", "Designer", "2023-11-14T22:13:20.000Z")
    assert (got["ashby"]["workplace"], got["ashby"]["description"]) == ("on_site", "Ops")
    assert boards.postings(raw).count() == 3


def test_registry(spark):
    c = spark.createDataFrame([("lever", "Acme", 1), ("lever", "acme", 2), ("ashby", "demo", 3), ("greenhouse", "beta", 4)], "provider string, slug string, pos int")
    assert [r["pos"] for r in registry.dedupe_candidates(c).orderBy("pos").collect()] == [1, 4]
    e = spark.createDataFrame([("lever", "a", "failed", 1), ("lever", "A", "verified", 2)], "provider string, slug string, status string, pos int")
    assert [r["pos"] for r in registry.dedupe_by_board(e).collect()] == [2]


def test_capped_counts_rows_before_the_budget(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([1, 0, 1, 1, 0])], "pos int, new int")
    assert [r["pos"] for r in incremental.capped(d, F.col("new") == 1, 2, ["pos"]).orderBy("pos").collect()] == [0, 1, 2]


def test_second_poll_changes_nothing(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string")
    stored = new.select("id", urls.description_hash(F.col("body")).alias("hash"))
    assert {r["action"] for r in incremental.actions(stored, new, "id", "body").collect()} == {"skip"}


def test_feed_limit_comes_before_filters(spark):
    jobs = spark.createDataFrame([(i, "t", "x", "new", i, None) for i in range(10)], "id int, title string, location string, status string, discovered int, salary_max double")
    analyses = spark.createDataFrame([(0, 1, 1, 99.0, "strong")], "job_id int, analysis_id int, created int, score double, classification string")
    assert feed.feed(jobs, analyses, limit=2, post=feed.after_limit(min_score=50)).count() == 0
    assert [r["id"] for r in feed.feed(jobs, analyses, limit=2).orderBy("rank").collect()] == [9, 8]


def test_grouped_matches(spark):
    d = spark.sql("select array(named_struct('status','gap','explanation','g'), named_struct('status','confirmed','explanation','c'), named_struct('status','odd','explanation','o')) as m")
    r = d.select(matching.grouped_matches(F.col("m")).alias("g")).first()["g"]
    assert (r["confirmed"], r["gaps"], r["transferable"]) == (["c"], ["g"], [])
