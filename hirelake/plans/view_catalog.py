"""Queries on trees, applications, imports and the merging of resume parts, with SQL that computes the same by itself."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions import resume_lines as rl
from hirelake.operators import imports, resume, views
from hirelake.plans.catalog import query, table
from hirelake.plans.derived import POSTS_SQL, Pick, posts, quoted
from hirelake.plans.posting_catalog import _dated, _firm, _titled, made, made_sql

# ---- trees and lists: orders are postings, return flags of an order its analyses, lines matches, parts requirements ----

_ANALYSIS = "l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _tables(spark, sf_dir):
    o, c, li, p, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part", "supplier"))
    flag = F.col("l_orderkey") * 3 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), (F.col("o_orderkey") % 50).alias("user_id"), F.col("o_orderdate").alias("seen"))
    companies = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # analyses and requirements are dealt by posting before they are counted, so that they lie where their posting is put together
    dated = li.select(F.col("l_orderkey").alias("job_id"), flag.alias("id"), "l_shipdate", "l_quantity").repartition("job_id")
    analyses = dated.groupBy("id", "job_id").agg(F.max("l_shipdate").alias("created"), F.max("l_quantity").alias("score"))
    pos = F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")
    matches = li.select(F.col("l_orderkey").alias("job_id"), flag.alias("analysis_id"), pos.alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).alias("requirement_id"), F.col("l_suppkey").alias("evidence_id"))
    asked = li.join(p.filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("job_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text")).repartition("job_id")
    requirements = asked.groupBy((F.col("job_id") * 10 + F.col("pos") % 10).alias("id"), "job_id").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    evidence = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return jobs, companies, requirements, analyses, matches, evidence


@query(
    f"""WITH r AS (SELECT l_orderkey * 10 + l_partkey % 10 AS id, l_orderkey AS job_id, min(l_partkey) AS pos, arg_min(p_name, l_partkey) AS text FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1, 2),
    a AS (SELECT {_ANALYSIS} AS id, any_value(l_orderkey) AS job_id, max(l_shipdate) AS created, max(l_quantity) AS score FROM lineitem GROUP BY 1),
    m AS (SELECT {_ANALYSIS} AS analysis_id, string_agg(coalesce(r.text, '-') || '/' || coalesce(s_name, '-'), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS shown FROM lineitem LEFT JOIN r ON r.id = l_orderkey * 10 + l_partkey % 10 LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey GROUP BY 1),
    t AS (SELECT job_id, count(*) AS n, string_agg(score::BIGINT || '[' || shown || ']', ';' ORDER BY created DESC, id DESC) AS tree FROM a JOIN m ON analysis_id = id GROUP BY 1),
    q AS (SELECT job_id, string_agg(text, ',' ORDER BY pos) AS asked FROM r GROUP BY 1)
    SELECT o_orderkey AS id, c_name AS company, coalesce(asked, '') AS asked, coalesce(n, 0) AS n_analyses, coalesce(tree, '') AS tree FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON t.job_id = o_orderkey LEFT JOIN q ON q.job_id = o_orderkey"""
)
def job_detail_tree(spark, sf_dir):
    d = views.job_tree(*_tables(spark, sf_dir))
    one = lambda m: F.concat(F.coalesce(m["requirement"]["text"], F.lit("-")), F.lit("/"), F.coalesce(m["evidence"]["text"], F.lit("-")))
    tree = F.transform("analyses", lambda a: F.concat(a["score"].cast("long").cast("string"), F.lit("["), F.array_join(F.transform(a["matches"], one), ","), F.lit("]")))
    asked = F.array_join(F.transform("requirements", lambda r: r["text"]), ",")
    return d.select("id", F.col("company.name").alias("company"), F.coalesce(asked, F.lit("")).alias("asked"), F.coalesce(F.size("analyses"), F.lit(0)).cast("long").alias("n_analyses"), F.coalesce(F.array_join(tree, ";"), F.lit("")).alias("tree"))


@query(
    f"""WITH a AS (SELECT {_ANALYSIS} AS id, any_value(l_orderkey) AS job_id, max(l_shipdate) AS created, max(l_quantity) AS score FROM lineitem GROUP BY 1), b AS (SELECT job_id, arg_max(score, (created, id)) AS score FROM a GROUP BY 1)
    SELECT event_id AS id, o_orderkey AS job_id, c_name AS company, score FROM events JOIN orders ON o_orderkey = event_id % 3000 AND user_id % 50 = o_orderkey % 50 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN b ON b.job_id = o_orderkey"""
)
def application_list(spark, sf_dir):
    jobs, companies, _, analyses, *_ = _tables(spark, sf_dir)
    apps = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("user_id"), (F.col("event_id") % 3000).alias("job_id"), F.col("ts").alias("updated"))
    return views.applications(apps, jobs, companies, analyses).select("id", "job_id", F.col("company.name").alias("company"), F.col("analysis.score").alias("score"))


@query("SELECT event_id AS id FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id % 3000 AND user_id % 50 = o_orderkey % 50)")
def foreign_applications(spark, sf_dir):
    jobs = _tables(spark, sf_dir)[0]
    apps = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("user_id"), (F.col("event_id") % 3000).alias("job_id"))
    return views.foreign_applications(apps, jobs).select("id")


@query("SELECT l_orderkey AS job_id, l_linenumber, s_name AS evidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS rank FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'")
def tailoring_list(spark, sf_dir):
    evidence = _tables(spark, sf_dir)[-1]
    s = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"), F.lit(1).alias("profile_id"), "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("id"), F.col("l_shipdate").alias("created"), F.col("l_suppkey").alias("evidence_id"))
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("created").desc(), F.col("id").desc()))
    return views.tailoring(s, evidence).withColumn("rank", rank).select("job_id", "l_linenumber", F.col("evidence.text").alias("evidence"), "rank")


@query("SELECT event_id, coalesce(u.at > ts, false) AS stale FROM events LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) u ON o_custkey = user_id")
def stale_analyses(spark, sf_dir):
    updated = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("at"))
    return table(spark, sf_dir, "events").join(updated, "user_id", "left").select("event_id", views.is_stale(F.col("ts"), F.col("at")).alias("stale"))


@query("SELECT p_brand || '-' || p_size AS name, arg_min(p_type, p_partkey) AS provider FROM part WHERE p_brand || '-' || p_size NOT IN (SELECT p_brand || '-' || p_size FROM part WHERE p_retailprice > 1700) GROUP BY 1")
def missing_companies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("provider"), F.col("p_partkey").alias("pos"), "p_retailprice")
    return views.missing_companies(p, p.filter("p_retailprice > 1700"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s_suppkey IS NULL THEN l_suppkey END AS evidence_id FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal < 3000")
def detached_evidence(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("evidence_id"))
    return views.detached(m, table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("id")))


@query(
    """WITH s AS (SELECT o_custkey AS id, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS skills FROM orders GROUP BY 1), e AS (SELECT user_id AS id, string_agg(event_id || ':' || event_type, '|' ORDER BY event_id) AS shown FROM events GROUP BY 1)
    SELECT c_custkey AS id, c_nationkey AS years, coalesce(skills, '') AS skills, coalesce(shown, '') AS evidence FROM customer LEFT JOIN s ON s.id = c_custkey LEFT JOIN e ON e.id = c_custkey"""
)
def profile_structs(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("years"), F.lit("remote").alias("remote_preference"), none.alias("preferred_locations"))
    skills = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"))
    evidence = table(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("id"), F.col("event_type").alias("text"), none.alias("skills"))
    d = views.profile_structs(profiles, skills, evidence)
    return d.select("id", "profile.years", F.array_join("profile.skills", "|").alias("skills"), F.array_join(F.transform("profile.evidence", lambda e: F.concat_ws(":", e["id"], e["text"])), "|").alias("evidence"))


@query(
    """SELECT c_custkey AS user_id, c_acctbal > 0 AS has_profile, c_custkey IN (SELECT s_suppkey FROM supplier) AS has_boards, c_custkey IN (SELECT o_custkey FROM orders) AS has_jobs, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS has_applications FROM customer"""
)
def first_steps(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, "text").otherwise("").alias("summary"), F.array().cast("array<string>").alias("target_titles"))
    boards = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    apps = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id")
    return views.first_steps(users.select("user_id"), users, boards, jobs, apps)


# ---- imports -------------------------------------------------------------------------------------------------------

_INPUT = {"a": Pick(["https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/beta/", "https://api.ashbyhq.com/posting-api/job-board/", "https://example.com/", '{"title": "x', "We hire engineers. See greenhouse.io/", "{broken ", "  Senior Developer in Toronto "], 1), "b": Pick(["", '"}', " and more"], 1, 1)}


@query(
    rf"""SELECT id, CASE WHEN trim(t) LIKE '{{%' AND json_valid(trim(t)) THEN 'manual' WHEN contains(t, 'greenhouse.io') THEN 'greenhouse' WHEN regexp_matches(t, '(jobs|api)\.lever\.co') THEN 'lever' WHEN contains(t, 'ashbyhq.com/') THEN 'ashby'
    WHEN NOT regexp_matches(trim(t), '^(https?://|\{{)') THEN 'pasted_description' WHEN trim(t) LIKE 'http%' THEN 'generic_web' ELSE 'manual' END AS provider FROM (SELECT id, a || id || b AS t FROM ({made_sql(_INPUT, "orders", "o_orderkey")}))"""
)
def import_provider(spark, sf_dir):
    d = made(spark, sf_dir, _INPUT, "orders", "o_orderkey")
    return d.select("id", imports.provider_of(F.concat("a", F.col("id").cast("string"), "b")).alias("provider"))


@query(
    rf"""WITH p AS ({POSTS_SQL}), t AS (SELECT id, trim(CASE id % 3 WHEN 0 THEN 'Role: ' || title || chr(10) || 'Company: Acme ' || id || chr(10) WHEN 1 THEN title || chr(10) || 'Location: ' || location || chr(10) ELSE '' END || description) AS t FROM p),
    f AS (SELECT id, t, trim(regexp_extract(t, '(?i)(?:title|position|role)[:\s]+([^\n]+)', 1)) AS named, trim(regexp_extract(t, '(?i)(?:company|organization)[:\s]+([^\n]+)', 1)) AS company, trim(regexp_extract(t, '(?i)location[:\s]+([^\n]+)', 1)) AS location, trim(string_split(t, chr(10))[1]) AS line FROM t),
    c AS (SELECT *, regexp_replace(CASE WHEN named <> '' THEN named WHEN length(line) <= 120 THEN line ELSE '' END, '\s+', ' ', 'g') AS title FROM f)
    SELECT id, CASE WHEN length(title) BETWEEN 1 AND 120 THEN title ELSE 'Untitled Role' END AS title, CASE WHEN company <> '' THEN company ELSE 'Unknown Company' END AS company, nullif(location, '') AS location, CASE WHEN regexp_matches(t, '(?i)remote') THEN 'remote' ELSE 'unknown' END AS workplace, sha256(t) AS text_sha FROM c"""
)
def pasted_postings(spark, sf_dir):
    extra = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Role: "), "title", F.lit("\nCompany: Acme "), F.col("id").cast("string"), F.lit("\n"))).when(F.col("id") % 3 == 1, F.concat("title", F.lit("\nLocation: "), "location", F.lit("\n"))).otherwise("")
    d = imports.from_text(posts(spark, sf_dir).select("id", F.concat(extra, "description").alias("text")))
    return d.select("id", "title", "company", "location", "workplace", F.sha2("description", 256).alias("text_sha"))


_LIMITED = {"company": Pick(["Acme", "", "x" * 201, None], 1), "title": Pick(["Engineer", "y" * 121, "Lead"], 1), "location": Pick(["Rome", "z" * 201, None], 3, 1), "workplace": Pick(["remote", "office", None], 1, 2), "job_url": Pick(["", "https://a.org/x", "not a url", None], 1, 1), "description": Pick(["Text", "", "Long text " * 3], 1, 1)}


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN company IS NULL OR length(company) NOT BETWEEN 1 AND 200 THEN 'company' END, CASE WHEN length(title) NOT BETWEEN 1 AND 120 THEN 'title' END, CASE WHEN length(location) > 200 THEN 'location' END,
    CASE WHEN workplace NOT IN ('remote', 'hybrid', 'on_site', 'unknown') THEN 'workplace' END, CASE WHEN job_url <> '' AND NOT contains(job_url, '://') THEN 'job_url' END, CASE WHEN description = '' THEN 'description' END], lambda x: x IS NOT NULL), ',') AS broken FROM ({made_sql(_LIMITED, "orders", "o_orderkey")})"""
)
def posting_limits(spark, sf_dir):
    d = made(spark, sf_dir, _LIMITED, "orders", "o_orderkey")
    return d.select("id", F.array_join(imports.broken_limits(d), ",").alias("broken"))


_FAILURE = {"m": Pick(["Failed to fetch Greenhouse job", "ENOTFOUND host", "Import payload too large", "ZodError: String must contain", "value is invalid", "invalidated", "Unauthorized", "other", "Network down"], 1)}


@query(
    rf"""SELECT id, CASE WHEN regexp_matches(lower(m), 'fetch|network|enotfound|could not reach') THEN {quoted(imports.REACH)} WHEN regexp_matches(lower(m), '(payload|import) too large') THEN {quoted(imports.LARGE)} WHEN regexp_matches(lower(m), 'zod|too big|too long|\binvalid\b|\bexpected string\b') THEN {quoted(imports.INVALID)}
    WHEN contains(lower(m), 'unauthorized') THEN {quoted(imports.SIGNED_OUT)} ELSE {quoted(imports.FAILED)} END AS message FROM ({made_sql(_FAILURE)})"""
)
def import_messages(spark, sf_dir):
    return made(spark, sf_dir, _FAILURE).select("id", imports.failure_message(F.col("m")).alias("message"))


# ---- parts of resumes that belong together -------------------------------------------------------------------------

_WALK = """walk(doc, no) AS (SELECT doc, min(no) FROM flagged GROUP BY doc UNION ALL SELECT w.doc, w.no + CASE WHEN f.fits THEN 2 ELSE 1 END FROM walk w JOIN flagged f USING (doc, no) WHERE w.no + CASE WHEN f.fits THEN 2 ELSE 1 END < f.n)"""
_WRAPPED = {f"l{i:02d}": Pick(["Built a design system for", "teams in many places.", "- A bullet that ends here", "with more words", "hyphen-", "ated word", "JANE DOE | 2020", "(and so on)", "Stop here:", "2 more lines", "ends with com-"], 2 * i + 1, i) for i in range(12)}


@query(
    rf"""WITH RECURSIVE l AS (SELECT id AS doc, unnest([{", ".join(_WRAPPED)}]) AS text, unnest(range(12)) AS no FROM ({made_sql(_WRAPPED)})),
    m AS (SELECT *, no // 5 AS page, text LIKE '- %' AS bullet, lead(text) OVER w AS following, lead(no // 5) OVER w = no // 5 AS same_page, lead(text LIKE '- %') OVER w AS next_bullet FROM l WINDOW w AS (PARTITION BY doc ORDER BY no)),
    flagged AS (SELECT doc, no, 12 AS n, text, following, regexp_matches(text, '\w-$') AS hyphen, following IS NOT NULL AND (regexp_matches(text, '\w-$') OR (same_page AND NOT bullet AND NOT next_bullet AND NOT regexp_full_match(following, '[A-Z0-9][A-Z0-9\s|@]+') AND regexp_matches(following, '^[a-z(0-9]') AND NOT regexp_matches(text, '[.!?:;]$'))) AS fits FROM m),
    {_WALK} SELECT doc, no AS line_no, CASE WHEN NOT fits THEN text WHEN hyphen THEN text || following ELSE text || ' ' || following END AS text FROM walk JOIN flagged USING (doc, no)"""
)
def wrapped_lines(spark, sf_dir):
    lines = made(spark, sf_dir, _WRAPPED).select(F.col("id").alias("doc"), F.posexplode(F.array(*_WRAPPED)).alias("line_no", "text"))
    lines = lines.select("doc", "line_no", F.floor(F.col("line_no") / 5).cast("int").alias("page"), "text", F.col("text").startswith("- ").alias("is_bullet"))
    return resume.merge_wrapped(lines).select("doc", "line_no", "text")


_TITLES, _DATES = ["Senior Engineer", None, "Jun 2020 - Present", "Acme Inc", "2019 - 2021", None, "Web Developer"], ["Jan 2020 - Present", None, "2018 - 2020", None]
_BLOCKS = {
    "company": Pick([None, "Beta Co", None, "Product Manager", None, "Gamma"], 1),
    "title": Pick(_TITLES, 1, 1),
    "date_text": Pick(_DATES, 1, 2),
    "location": Pick(["Toronto", None, "Remote"], 1),
    "header": Pick(["Acme Inc", "Senior Engineer | Acme", "Jun 2020 - Present", "Gamma Labs"], 5, 1),
    "n_bullets": Pick([0, 2, 0, 1, 0], 3),
}
_YEARS = f"'{rl.YEAR_RANGE}'".replace("\\d", "[0-9]")


def _only_company(x: str) -> str:
    name = f"coalesce({x}.title, {x}.header)"
    return f"({x}.company IS NULL AND NOT regexp_matches({name}, {_YEARS}) AND NOT contains({name}, '|') AND ({x}.n_bullets > 0 OR {x}.date_text IS NULL))"


@query(
    rf"""WITH RECURSIVE k AS (SELECT id // 6 AS doc, id % 6 AS no, * EXCLUDE (id) FROM ({made_sql(_BLOCKS, "orders", "o_orderkey")})), g AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY no) - 1 AS nth FROM k),
    j AS (SELECT a.doc, a.no AS block_no, a.nth, count(*) OVER (PARTITION BY a.doc) AS n, a, b, CASE WHEN b.doc IS NULL THEN 0
        WHEN a.title IS NOT NULL AND a.date_text IS NOT NULL AND a.company IS NULL AND a.n_bullets = 0 AND b.company IS NOT NULL AND b.title IS NULL AND b.date_text IS NULL AND b.n_bullets > 0 THEN 1
        WHEN a.title IS NOT NULL AND a.date_text IS NOT NULL AND a.company IS NULL AND a.n_bullets = 0 AND {_only_company("b")} AND b.n_bullets > 0 THEN 2
        WHEN regexp_matches(a.title, {_YEARS}) AND NOT regexp_matches(a.company, {_YEARS}) AND a.n_bullets = 0 AND {_only_company("b")} THEN 3
        WHEN {_only_company("a")} AND (b.date_text IS NOT NULL OR regexp_matches(b.header, {_YEARS}) OR contains(b.header, '|')) THEN 4
        WHEN {_only_company("a")} AND a.n_bullets = 0 AND b.n_bullets > 0 AND b.company IS NULL AND regexp_matches(b.title, {_YEARS}) THEN 5 ELSE 0 END AS rule FROM g a LEFT JOIN g b ON a.doc = b.doc AND b.nth = a.nth + 1),
    flagged AS (SELECT *, nth AS no, rule > 0 AS fits FROM j), {_WALK}
    SELECT doc, block_no, CASE rule WHEN 0 THEN a.company WHEN 1 THEN b.company WHEN 4 THEN coalesce(a.title, a.header) WHEN 5 THEN coalesce(a.title, a.header) ELSE coalesce(b.title, b.header) END AS company,
    CASE rule WHEN 3 THEN a.company WHEN 4 THEN coalesce(b.title, b.company) WHEN 5 THEN b.company ELSE a.title END AS title, CASE rule WHEN 3 THEN coalesce(a.title, a.date_text) WHEN 4 THEN coalesce(b.date_text, CASE WHEN regexp_matches(b.title, {_YEARS}) THEN b.title END) WHEN 5 THEN b.title ELSE a.date_text END AS date_text,
    CASE WHEN rule = 0 THEN a.location WHEN rule = 4 THEN coalesce(b.location, a.location) WHEN rule = 5 THEN b.location ELSE coalesce(a.location, b.location) END AS location, a.n_bullets + CASE WHEN rule > 0 THEN b.n_bullets ELSE 0 END AS n_bullets FROM walk JOIN flagged USING (doc, no)"""
)
def split_blocks(spark, sf_dir):
    d = made(spark, sf_dir, _BLOCKS, "orders", "o_orderkey").withColumns({"doc": F.floor(F.col("id") / 6), "block_no": F.col("id") % 6, "lines": F.array().cast("array<string>")})
    return resume.merge_split_blocks(d).select("doc", "block_no", "company", "title", "date_text", "location", "n_bullets")


_ENTRIES = {"company": Pick([None, "Acme Inc", None, "Product Manager", "Gamma Labs"], 1), "title": Pick(["Senior Engineer", "06/2020 - Present", None, "Acme Inc", "Web Developer"], 3, 1), "start_text": Pick(["2020", None, None], 1), "achievements": Pick([[], ["Built it"], [], ["Led it", "Wrote it"]], 1, 1)}


@query(
    rf"""WITH RECURSIVE k AS (SELECT id // 5 AS doc, id % 5 AS entry_no, row_number() OVER (PARTITION BY id // 5 ORDER BY id) - 1 AS no, * EXCLUDE (id) FROM ({made_sql(_ENTRIES, "orders", "o_orderkey")})),
    j AS (SELECT a.doc, a.entry_no, a.no, count(*) OVER (PARTITION BY a.doc) AS n, a, b, coalesce({_dated("a.title")}, false) AS dated, coalesce({_titled("a.company")}, false) AS worker, coalesce({_firm("b.title")}, false) AND b.company IS NULL AS firm FROM k a LEFT JOIN k b ON a.doc = b.doc AND b.no = a.no + 1),
    flagged AS (SELECT *, coalesce(len(a.achievements) = 0 AND len(b.achievements) > 0 AND ((dated AND worker AND firm) OR ((a.start_text IS NOT NULL OR dated) AND (a.title IS NOT NULL OR a.company IS NOT NULL) AND (coalesce({_firm("b.company")}, false) OR firm))), false) AS fits FROM j), {_WALK},
    o AS (SELECT doc, entry_no, CASE WHEN fits THEN coalesce(b.company, CASE WHEN {_firm("b.title")} THEN b.title END, a.company) ELSE a.company END AS company, CASE WHEN fits THEN CASE WHEN worker THEN a.company WHEN a.title IS NOT NULL AND NOT dated THEN a.title WHEN {_titled("b.title")} THEN b.title ELSE a.title END ELSE a.title END AS title,
    CASE WHEN fits AND dated THEN a.title ELSE a.start_text END AS start_text, array_to_string(CASE WHEN fits THEN list_concat(a.achievements, b.achievements) ELSE a.achievements END, '|') AS achievements FROM walk JOIN flagged USING (doc, no))
    SELECT * FROM o WHERE company IS NOT NULL OR title IS NOT NULL OR start_text IS NOT NULL OR achievements <> ''"""
)
def same_experience(spark, sf_dir):
    none = F.array().cast("array<string>")
    d = made(spark, sf_dir, _ENTRIES, "orders", "o_orderkey").withColumns({"doc": F.floor(F.col("id") / 5), "entry_no": F.col("id") % 5, "achievements": F.coalesce("achievements", none)})
    return resume.merge_fragments(d).select("doc", "entry_no", "company", "title", "start_text", F.array_join("achievements", "|").alias("achievements"))
