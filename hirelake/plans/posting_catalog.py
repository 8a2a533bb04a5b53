"""Queries on addresses, dates, boards, resumes and answers that are derived from the driver tables, with SQL that
computes the same by itself. Patterns that both engines need are the fixed values of the library, written for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import dates, options, resume_lines, text, urls
from hirelake.operators import boards, resume
from hirelake.plans.catalog import ORACLES, query, table
from hirelake.plans.derived import Pick, columns, columns_sql, quoted, spread
from hirelake.sources import fixtures


def made(spark, sf_dir, picks: dict[str, Pick], source: str = "customer", key: str = "c_custkey"):
    """id and a phrase of each list for every row of a table."""
    return spread(table(spark, sf_dir, source).select(F.col(key).alias("id")), "id").select("id", *columns(picks, "id"))


def made_sql(picks: dict[str, Pick], source: str = "customer", key: str = "c_custkey") -> str:
    return f"SELECT id, {columns_sql(picks, 'id')} FROM (SELECT {key} AS id FROM {source})"


# ---- entities --------------------------------------------------------------------------------------------------

_ENTITY = {"a": Pick(["&amp;lt;", "&copy;", "&AMP;", "&#128512;", "&#1114112;", "&;", "&", "&lt;b&gt;", "&nbsp;", "&quot;", "&apos;", "&#xD800;", "&#x1F600;"], 1), "b": Pick(["&", "&gt", "&Lt;", "x", "&&amp;"], 1, 2)}
_TOKEN = r"""CASE WHEN NOT regexp_full_match(k, '&.+;') THEN k
    WHEN regexp_full_match(k, '&#x[0-9a-fA-F]{1,8};') THEN (CASE WHEN ('0x' || k[4:-2])::BIGINT > 1114111 OR ('0x' || k[4:-2])::BIGINT BETWEEN 55296 AND 57343 THEN k ELSE chr(('0x' || k[4:-2])::INTEGER) END)
    WHEN regexp_full_match(k, '&#[0-9]{1,9};') THEN (CASE WHEN k[3:-2]::BIGINT > 1114111 OR k[3:-2]::BIGINT BETWEEN 55296 AND 57343 THEN k ELSE chr(k[3:-2]::INTEGER) END)
    ELSE coalesce(MAP {'amp': '&', 'lt': '<', 'gt': '>', 'quot': '"', 'apos': '''', 'nbsp': ' '}[lower(k[2:-2])], k) END"""


@query(rf"""SELECT id, array_to_string(list_transform(regexp_extract_all(p_name || a || '&#' || (65 + id % 26) || ';' || b, '&(?:#x?[0-9a-fA-F]+|\w+);|[^&]+|&'), lambda k: {_TOKEN}), '') AS decoded FROM (SELECT p_partkey AS id, p_name, {columns_sql(_ENTITY, "p_partkey")} FROM part)""")
def html_entities(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").select("id", "p_name", *columns(_ENTITY, "id"))
    number = F.concat(F.lit("&#"), (65 + F.col("id") % 26).cast("string"), F.lit(";"))
    return d.select("id", text.decode_entities(F.concat("p_name", "a", number, "b")).alias("decoded"))


# ---- addresses and slugs ---------------------------------------------------------------------------------------

_ADDRESS = {
    "scheme": Pick(["https://", "http://", "ftp://", " https://"], 1),
    "host": Pick(["boards.greenhouse.io/", "job-boards.greenhouse.io/", "boards-api.greenhouse.io/v1/boards/", "jobs.lever.co/", "api.ashbyhq.com/posting-api/job-board/", "jobs.ashbyhq.com/", "example.com/"], 1, 3),
    "slug": Pick(["acme", "Beta-Co", "gamma", "x_y", "delta.io"], 1, 1),
    "tail": Pick(["", "/", "/jobs", "/jobs/12345", "?team=x", "/0a1b2c3d-4e5f", "//", "/jobs/"], 3, 1),
}
_ADDRESS_SQL = rf"SELECT id, scheme || host || slug || id || tail AS raw, regexp_replace(trim(scheme || host || slug || id || tail), '/+$', '') AS t FROM ({made_sql(_ADDRESS)})"
_BOARD = r"""SELECT *, regexp_extract(t, '(?i)(?:boards-api\.greenhouse\.io/v1/boards|(?:boards|job-boards)\.greenhouse\.io|jobs\.lever\.co|api\.ashbyhq\.com/posting-api/job-board|jobs\.ashbyhq\.com)/([^/?#]+)', 1) AS slug,
    CASE WHEN NOT regexp_matches(t, '(?i)^https?://') THEN NULL WHEN contains(t, 'greenhouse.io/') THEN 'greenhouse' WHEN contains(t, 'lever.co/') THEN 'lever' WHEN contains(t, 'ashbyhq.com/') THEN 'ashby' END AS provider,
    contains(t, '-api.greenhouse') OR contains(t, '//api.ashbyhq') AS api, regexp_matches(t, '(?i)/jobs/[0-9]+') AS numbered, regexp_matches(t, '(?i)(lever\.co|jobs\.ashbyhq\.com)/[^/?#]+/[a-f0-9-]+') AS lettered FROM a"""


@query(
    rf"""WITH a AS ({_ADDRESS_SQL}), b AS ({_BOARD}), c AS (SELECT *, CASE WHEN provider IS NULL THEN NULL WHEN api THEN false WHEN provider = 'greenhouse' THEN numbered ELSE lettered END AS single FROM b)
    SELECT id, provider, CASE WHEN provider IS NOT NULL THEN slug END AS slug, CASE WHEN provider IS NULL THEN NULL WHEN single THEN t WHEN provider = 'greenhouse' AND NOT api THEN regexp_replace(t, '(?i)/jobs/?$', '')
        ELSE MAP {quoted(urls.LISTING)}[provider] || slug END AS url, single::VARCHAR AS single, CASE WHEN provider IS NULL THEN 'invalid' WHEN single THEN 'single_job' END AS error FROM c"""
)
def url_parse(spark, sf_dir):
    d = made(spark, sf_dir, _ADDRESS).select("id", F.concat("scheme", "host", "slug", F.col("id").cast("string"), "tail").alias("raw")).withColumn("p", urls.parse_board_url(F.col("raw")))
    return d.select("id", F.col("p.provider").alias("provider"), F.col("p.board_slug").alias("slug"), F.col("p.board_url").alias("url"), F.col("p.is_single_job").cast("string").alias("single"), urls.board_url_error(F.col("raw")).alias("error"))


_SLUG = {"slug": Pick(["acme", "", "internet", "a", "deadbeef00", "a b", "Acme-Co.2", " beta ", "my-test", "-x", "x" * 80], 1), "tail": Pick(["", "-co", "1", "Z"], 1, 1)}


@query(
    rf"""SELECT id, length(trim(slug || tail)) BETWEEN 2 AND 80 AND regexp_full_match(trim(slug || tail), '(?i)[a-z0-9][a-z0-9._-]*') AND NOT regexp_full_match(trim(slug || tail), '[0-9]+|(?i:[a-f0-9]{{8,}})|[a-z]{{1,2}}')
    AND NOT regexp_matches(trim(slug || tail), '(?i)test|demo|sandbox|example|intern') AS plausible FROM ({made_sql(_SLUG, "orders", "o_orderkey")})"""
)
def plausible_slugs(spark, sf_dir):
    return made(spark, sf_dir, _SLUG, "orders", "o_orderkey").select("id", urls.is_plausible_slug(F.concat("slug", "tail")).alias("plausible"))


# ---- dates and options -----------------------------------------------------------------------------------------

_RANGE = {
    "head": Pick(["Jun 2022", "6/2021", "2019", "March 2018", "Sept. 2015", "soon", "12/1999", "Dez 2001", " feb 2003"], 1),
    "dash": Pick([" - ", " – ", " to ", "—", ""], 1, 1),
    "tail": Pick(["Present", "now", "12/2022", "2020", "Nov 2020", "later"], 1, 2),
}


def _month(x: str) -> str:
    t = f"lower(trim({x}))"
    names = "MAP {" + ", ".join(f"'{m}': '{i + 1:02d}'" for i, m in enumerate(dates.MONTHS)) + "}"
    return rf"""CASE WHEN regexp_full_match({t}, '[a-z]{{3}}[a-z]*\.?\s+[0-9]{{4}}') THEN {t}[-4:] || '-' || {names}[{t}[1:3]] WHEN regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{4}}') THEN {t}[-4:] || '-' || lpad(string_split({t}, '/')[1], 2, '0') WHEN regexp_full_match({t}, '[0-9]{{4}}') THEN {t} || '-01' END"""


@query(
    rf"""WITH r AS (SELECT id, string_split_regex(trim(head || dash || tail), '\s*[-–—]\s*|\s+to\s+') AS p FROM ({made_sql(_RANGE, "orders", "o_orderkey")})), s AS (SELECT *, coalesce(regexp_matches(lower(p[2]), 'present|current|now'), false) AS current FROM r)
    SELECT id, {_month("p[1]")} AS start, CASE WHEN NOT current THEN {_month("p[2]")} END AS finish, current::VARCHAR AS current FROM s"""
)
def date_tokens(spark, sf_dir):
    d = made(spark, sf_dir, _RANGE, "orders", "o_orderkey").withColumn("r", dates.date_range(F.concat("head", "dash", "tail")))
    return d.select("id", F.col("r.start").alias("start"), F.col("r.end").alias("finish"), F.col("r.current").cast("string").alias("current"))


_VALUE = {"a": Pick(["Canadian Citizen", "Principal", "senior", "open work permit", "Permanent Resident", "authorized in the US", "needs sponsorship", "mid", "team Lead", "junior"], 1), "b": Pick([", Onsite", " / hybrid", "", " remote", " on-site", "?"], 1, 1)}


def _option_sql(table_: tuple) -> str:
    return f"CASE WHEN v IN {tuple(table_[0])} THEN v " + " ".join(f"WHEN regexp_matches(lower(v), '{p}') THEN '{name}'" for p, name in table_[1]) + " ELSE '' END"


@query(f"SELECT id, {_option_sql(options.WORK)} AS work, {_option_sql(options.SENIORITY)} AS seniority, {_option_sql(options.REMOTE)} AS remote FROM (SELECT id, a || b AS v FROM ({made_sql(_VALUE, 'orders', 'o_orderkey')}))")
def profile_options(spark, sf_dir):
    v = F.concat("a", "b")
    return made(spark, sf_dir, _VALUE, "orders", "o_orderkey").select("id", options.work_authorization(v).alias("work"), options.seniority(v).alias("seniority"), options.remote_preference(v).alias("remote"))


@query("SELECT 'perf-' || k AS source_job_id, 'Software Engineer ' || k AS title, CASE WHEN k % 2 = 0 THEN 'remote' ELSE 'hybrid' END AS workplace, strftime(TIMESTAMP '2024-01-01 00:00:00' - to_minutes(k), '%Y-%m-%d %H:%M') AS discovered FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS k)")
def load_rows(spark, sf_dir):
    d = fixtures.load_postings(spark, table(spark, sf_dir, "orders").count(), "2024-01-01 00:00:00")
    return d.select("source_job_id", "title", "workplace", F.date_format("discovered", "yyyy-MM-dd HH:mm").alias("discovered"))


# ---- boards ----------------------------------------------------------------------------------------------------

_BOARD_PICKS = {
    "provider": Pick(["greenhouse", "lever", "ashby", "other"], 1),
    "slug": Pick(["acme_labs", "beta-co", "gamma"], 1, 1),
    "title": Pick(["Web  Engineer", "Designer &amp; Writer", "Ops", "Lead"], 3, 1),
    "place": Pick(["Remote - Canada", "Oslo", "Rome", ""], 1, 2),
    "html": Pick(["<p>Hi &amp; bye</p>", "<ul><li>One</li><li>Two</li></ul>", "Plain text", "<div>More</div><div>Text</div>"], 5, 1),
    "kind": Pick(["OnSite", "Hybrid", "Remote", ""], 3),
}
_JSON = {
    "greenhouse": '{"board":"%slug%","jobs":[{"id":%id%,"title":"%title%","location":{"name":"%place%"},"absolute_url":"http://x/%id%","content":"%html%","updated_at":"2024-01-01"}]}',
    "lever": '[{"id":"p%id%","text":"%html%","hostedUrl":"http://y/%id%","categories":{"location":"%place%"},"createdAt":1700000000000}]',
    "ashby": '{"companyName":"Gamma %id%","jobs":[{"id":"a%id%","title":"%title%","isRemote":false,"workplaceType":"%kind%","location":"%place%","publishedAt":"2024-02-02","descriptionHtml":"%html%"}]}',
    "other": "{}",
}


def _board_name_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split_regex({x}, '[-_]'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _filled_sql(template: str) -> str:
    out = quoted(template)
    for name in ("slug", "title", "place", "html", "kind"):
        out = f"replace({out}, '%{name}%', {name})"
    return f"replace({out}, '%id%', id::VARCHAR)"


_TAGS_SQL = r"trim(regexp_replace(replace(replace(regexp_replace(replace(replace(replace(replace({x}, '</p>', chr(10) || chr(10)), '</div>', chr(10)), '</li>', chr(10)), '<li>', '• '), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '\s+$', ''))"
_CLEAN_SQL = r"replace(regexp_replace(trim({x}), '\s+', ' ', 'g'), '&amp;', '&')"


@query(
    rf"""WITH b AS (SELECT *, CASE provider {" ".join(f"WHEN '{p}' THEN {_filled_sql(t)}" for p, t in _JSON.items())} END::JSON AS j FROM ({made_sql(_BOARD_PICKS)})),
    g AS (SELECT provider, {_board_name_sql("j->>'$.board'")} AS company, {_CLEAN_SQL.format(x="j->>'$.jobs[0].title'")} AS title, CASE WHEN regexp_matches(coalesce(j->>'$.jobs[0].location.name', ''), '(?i)remote') THEN 'remote' ELSE 'unknown' END AS workplace, j->>'$.jobs[0].id' AS source_job_id, j->>'$.jobs[0].updated_at' AS date_posted, {_TAGS_SQL.format(x="j->>'$.jobs[0].content'")} AS description FROM b WHERE provider = 'greenhouse'),
    l AS (SELECT provider, {_board_name_sql("slug")} AS company, {_CLEAN_SQL.format(x="string_split(" + _TAGS_SQL.format(x="j->>'$[0].text'") + ", chr(10))[1]")} AS title, CASE WHEN regexp_matches(coalesce(j->>'$[0].categories.location', ''), '(?i)remote') THEN 'remote' ELSE 'unknown' END AS workplace, j->>'$[0].id' AS source_job_id, '2023-11-14T22:13:20.000Z' AS date_posted, {_TAGS_SQL.format(x="j->>'$[0].text'")} AS description FROM b WHERE provider = 'lever'),
    a AS (SELECT provider, j->>'$.companyName' AS company, {_CLEAN_SQL.format(x="j->>'$.jobs[0].title'")} AS title, CASE lower(j->>'$.jobs[0].workplaceType') WHEN 'remote' THEN 'remote' WHEN 'hybrid' THEN 'hybrid' WHEN 'onsite' THEN 'on_site' ELSE CASE WHEN regexp_matches(j->>'$.jobs[0].location', '(?i)remote') THEN 'remote' ELSE 'unknown' END END AS workplace, j->>'$.jobs[0].id' AS source_job_id, j->>'$.jobs[0].publishedAt' AS date_posted, {_TAGS_SQL.format(x="j->>'$.jobs[0].descriptionHtml'")} AS description FROM b WHERE provider = 'ashby')
    SELECT * FROM g UNION ALL SELECT * FROM l UNION ALL SELECT * FROM a"""
)
def board_postings(spark, sf_dir):
    d = made(spark, sf_dir, _BOARD_PICKS)
    payload = F.lit(None).cast("string")
    for provider, template in _JSON.items():
        filled = F.lit(template)
        for name in ("slug", "title", "place", "html", "kind"):
            filled = F.replace(filled, F.lit(f"%{name}%"), F.col(name))
        payload = F.when(F.col("provider") == provider, F.replace(filled, F.lit("%id%"), F.col("id").cast("string"))).otherwise(payload)
    raw = d.select("provider", F.concat(F.lit("https://jobs.lever.co/"), "slug").alias("url"), payload.alias("payload"))
    return boards.normalize(raw).select("provider", "company", "title", "workplace", "source_job_id", "date_posted", "description")


# ---- resumes ---------------------------------------------------------------------------------------------------

_RESUME = {
    "l00": Pick(["Jane Doe", "John Q. Public", "Ana Ruiz", "Li Wei"], 1),
    "l01": Pick(["Web person", "Senior Engineer", "I like to build things for people who like things that are built well and last long", None], 1, 1),
    "l02": Pick(["jane@example.com", "call +1 (416) 555-0199", "https://github.com/jane/code https://jane.dev", "linkedin.com/in/jane"], 1, 2),
    "l03": Pick(["Toronto, Canada", "Location: Remote", "Nowhere", None], 3, 1),
    "l04": Pick(["Experience", "WORK EXPERIENCE", "Employment history"], 1),
    "l05": Pick(["Senior Engineer | Acme", "Acme Inc", "Web Developer | Beta Co | Jun 2018 - Present", "Jun 2020 - Present"], 1, 3),
    "l06": Pick(["Jun 2020 - Present", "Frontend Engineer | 01/2019 – 12/2021 | Toronto", "- Built a design system for teams", "Lead Designer"], 5, 1),
    "l07": Pick(["- Built a design system for teams", "Maintained build servers and release tooling for all", "• short", "- Reduced page weight by 40% on all client pages."], 7),
    "l08": Pick(["Increased sales. Led people across several groups and offices", "2019 - 2020", None, "* Wrote docs"], 3, 2),
    "l09": Pick(["Product Manager | Gamma", None, "Gamma Labs"], 1, 1),
    "l10": Pick(["03/2015 - 04/2017", None], 1),
    "l11": Pick(["Migrated services to another platform", "- x"], 1, 1),
    "l12": Pick(["Skills", "Core Technical Skills", "Education"], 1, 1),
    "l13": Pick(["Languages: TypeScript, Go", "Docker", "Tools:", "React, Vue; Svelte"], 1),
    "l14": Pick(["Figma, Jira", "Data & Cloud: AWS, SQL | Spark", "Testing", "Other:"], 3, 1),
    "l15": Pick(["Playwright", "Jest, Vitest", None], 1, 2),
}


def _resume(spark, sf_dir):
    d = made(spark, sf_dir, _RESUME)
    lines = F.filter(F.array(*_RESUME), lambda x: x.isNotNull())
    return d.select(F.col("id").alias("doc"), F.posexplode(lines).alias("line_no", "text"))


_HEAD_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(trim(text), '(?i){p}') THEN '{name}'" for name, p in resume_lines.HEADINGS.items()) + " END"
_RESUME_SQL = f"""lines AS (SELECT doc, unnest(ls) AS text, unnest(range(len(ls))) AS line_no FROM (SELECT id AS doc, list_filter([{", ".join(_RESUME)}], lambda x: x IS NOT NULL) AS ls FROM ({made_sql(_RESUME)}))),
headed AS (SELECT *, CASE WHEN length(trim(text)) <= 60 THEN {_HEAD_SQL} END AS head FROM lines),
parts AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, 'contact') AS section FROM headed WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) QUALIFY head IS NULL)"""


@query(f"WITH {_RESUME_SQL} SELECT doc, line_no, section FROM parts")
def resume_sections(spark, sf_dir):
    return resume.sections(_resume(spark, sf_dir)).select("doc", "line_no", "section")


_MAIL, _CALL, _LINKED, _HUB, _WEB = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?[0-9][0-9\s().-]{7,}[0-9]", r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[\w/-]+", r"(?i)(?:https?://)?(?:www\.)?github\.com/[\w/-]+", r"(?i)https?://[^\s|]+"
_TOWN = r"(?i)(?:^|\|)\s*[A-Za-z .,-]+(?:Canada|USA|United States|Remote|Toronto|Vancouver|Ontario)\b"


@query(
    rf"""WITH {_RESUME_SQL}, c AS (SELECT doc, list(text ORDER BY line_no) AS ls, string_agg(text, chr(10) ORDER BY line_no) AS t FROM parts WHERE section = 'contact' GROUP BY doc),
    p AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '{_MAIL}') AND NOT regexp_matches(x, '{_CALL}') AND NOT regexp_matches(x, '{_LINKED}') AND NOT regexp_matches(x, '{_HUB}') AND NOT regexp_matches(x, '{_WEB}')) AS plain,
    list_filter(ls, lambda x: regexp_matches(x, '{_TOWN}'))[1] AS place, nullif(regexp_extract(t, '{_HUB}'), '') AS github, nullif(regexp_extract(t, '{_LINKED}'), '') AS linkedin FROM c)
    SELECT doc, trim(plain[1]) AS full_name, CASE WHEN length(plain[2]) < 80 THEN trim(plain[2]) END AS headline, nullif(regexp_extract(t, '{_MAIL}'), '') AS email, nullif(trim(regexp_extract(t, '{_CALL}')), '') AS phone, trim(regexp_replace(place, '(?i)^location:\s*', '')) AS location, linkedin, github,
    list_filter(regexp_extract_all(t, '{_WEB}'), lambda u: NOT coalesce(contains(linkedin, u), false) AND NOT coalesce(contains(github, u), false))[1] AS portfolio FROM p"""
)
def resume_contact(spark, sf_dir):
    lines = resume.lines_of(resume.sections(_resume(spark, sf_dir)), "contact")
    return lines.select("doc", resume.contact(F.col("lines")).alias("c")).select("doc", "c.*")


@query(
    rf"""WITH {_RESUME_SQL}, k AS (SELECT doc, line_no, text, regexp_matches(text, '^[A-Za-z][A-Za-z\s/&]+:\s*.*,') AS pair, text LIKE '%:' AND length(text) < 40 AS bare FROM parts WHERE section = 'skills'),
    g AS (SELECT *, sum(CASE WHEN pair OR bare THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS group_no, CASE WHEN pair THEN trim(regexp_extract(text, '^([A-Za-z][A-Za-z\s/&]+):', 1)) WHEN bare THEN trim(text[:-2]) END AS category,
    CASE WHEN pair THEN regexp_replace(text, '^[A-Za-z][A-Za-z\s/&]+:\s*', '') WHEN bare THEN '' ELSE text END AS rest FROM k),
    s AS (SELECT doc, group_no, line_no, unnest(CASE WHEN contains(rest, ',') THEN string_split_regex(rest, '[,;|]') ELSE [rest] END) AS skill, unnest(range(20)) AS no FROM g)
    SELECT s.doc, s.group_no::BIGINT AS group_no, c.category, string_agg(trim(skill), '|' ORDER BY line_no, no) AS skills FROM s JOIN (SELECT doc, group_no, max(category) AS category FROM g GROUP BY ALL) c USING (doc, group_no) WHERE trim(skill) <> '' GROUP BY ALL"""
)
def resume_skills(spark, sf_dir):
    groups = resume.skill_groups(resume.sections(_resume(spark, sf_dir)).filter("section = 'skills'"))
    return groups.select("doc", "group_no", "category", F.array_join("skills", "|").alias("skills"))


_WORD_MONTH = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*|[0-9]{1,2})[\s./-]*[0-9]{2,4}"
_DONE = "built|developed|led|designed|implemented|migrated|shipped|improved|reduced|increased|delivered|owned|architected|created|maintained|collaborated|optimized|automated|scaled|mentored|launched"


def _dated(x: str) -> str:
    return rf"regexp_matches(trim({x}), '(?i)\b{_WORD_MONTH}\b[\s–—-]+.*\b(?:present|current|{_WORD_MONTH}|[0-9]{{2,4}})\b')"


def _titled(x: str) -> str:
    return rf"(length(trim({x})) <= 80 AND regexp_matches(trim({x}), '(?i)\b(?:developer|engineer|instructor|architect|consultant|designer|manager)\b') AND NOT {_dated(x)})"


def _acted(x: str) -> str:
    return rf"regexp_matches(trim({x}), '(?i)\b(?:{_DONE}|worked|contributed|achieved)\b')"


def _firm(x: str) -> str:
    return f"(length(trim({x})) BETWEEN 2 AND 120 AND NOT {_dated(x)} AND NOT {_titled(x)} AND trim({x}) NOT LIKE '%.' AND NOT ({_acted(x)} AND length(trim({x})) > 40))"


def _contact_line(x: str) -> str:
    return rf"(length(trim({x})) < 3 OR regexp_matches(trim({x}), '@\w+\.\w+|(?i:\b(linkedin\.com|github\.com)\b)|^\+?[0-9][0-9\s().-]{{7,}}[0-9]$|^(?i:https?://|www\.)|^(?i:experience|work experience|employment|education|skills|projects|summary|contact|certifications|technical skills)$|^[0-9]{{4}}\s*[-–—]\s*(?i:present|[0-9]{{4}})'))"


def _kept(x: str) -> str:
    clean = rf"list_filter(list_transform({x}, lambda b: trim(regexp_replace(trim(b), '^[-•*–—]\s+', ''))), lambda b: length(b) > 0 AND NOT {_contact_line('b')})"
    return rf"list_filter({clean}, lambda b: regexp_matches(b, '^[-•*–—]\s+') OR ({_acted('b')} AND length(b) >= 20) OR length(b) >= 40)"


@query(
    rf"""WITH {_RESUME_SQL}, m AS (SELECT doc, line_no, text, (regexp_matches(text, '^[-•*–—]\s+') OR (length(trim(text)) > 0 AND NOT {_dated("text")} AND ({_acted("text")} OR (length(trim(text)) > 35 AND regexp_matches(text, '[.!]'))) AND NOT {_titled("text")})) AND NOT {_dated("text")} AS bullet FROM parts WHERE section = 'experience'),
    h AS (SELECT *, NOT bullet AND ({_dated("text")} OR contains(text, '|') OR {_titled("text")} OR {_firm("text")}) AS head FROM m),
    n AS (SELECT *, sum(CASE WHEN head AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS block_no FROM (SELECT *, lag(head) OVER (PARTITION BY doc ORDER BY line_no) AS before FROM h)),
    b AS (SELECT doc, block_no, list_filter(list_transform(flatten(list(string_split(text, '|') ORDER BY line_no) FILTER (head)), lambda x: trim(x)), lambda x: x <> '') AS head, list(text ORDER BY line_no) FILTER (NOT head) AS body FROM n GROUP BY ALL),
    f AS (SELECT doc, block_no, list_filter(head, lambda x: {_titled("x")})[1] AS title, list_filter(head, lambda x: {_firm("x")} AND NOT regexp_matches(x, '(?i)\b(remote|canada|toronto|lagos|ontario|usa|united states)\b'))[1] AS company, string_split_regex(list_filter(head, lambda x: {_dated("x")})[1], '\s*[-–—]\s*|\s+to\s+') AS p, coalesce({_kept("body")}, []) AS bullets FROM b)
    SELECT doc, block_no::BIGINT AS block_no, title, company, {_month("p[1]")} AS start, CASE WHEN NOT coalesce(regexp_matches(lower(p[2]), 'present|current|now'), false) THEN {_month("p[2]")} END AS finish, coalesce(regexp_matches(lower(p[2]), 'present|current|now'), false) AS current, array_to_string(bullets, '|') AS bullets
    FROM f WHERE title IS NOT NULL OR company IS NOT NULL OR p IS NOT NULL OR len(bullets) > 0"""
)
def resume_blocks(spark, sf_dir):
    blocks = resume.reconciled(resume.experience_blocks(resume.sections(_resume(spark, sf_dir)).filter("section = 'experience'")))
    return blocks.select("doc", "block_no", "title", "company", F.col("dates.start").alias("start"), F.col("dates.end").alias("finish"), F.col("dates.current").alias("current"), F.array_join("bullets", "|").alias("bullets"))


@query(
    f"""SELECT c.doc, full_name, email, coalesce(n_groups, 0) AS n_groups, coalesce(n_entries, 0) AS n_entries, coalesce(n_current, 0) AS n_current FROM ({ORACLES["resume_contact"]}) c LEFT JOIN (SELECT doc, count(*) AS n_groups FROM ({ORACLES["resume_skills"]}) GROUP BY 1) g USING (doc)
    LEFT JOIN (SELECT doc, count(*) AS n_entries, count(*) FILTER (current) AS n_current FROM ({ORACLES["resume_blocks"]}) GROUP BY 1) e USING (doc)"""
)
def resume_tree(spark, sf_dir):
    d = resume.parsed(_resume(spark, sf_dir))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return d.select("doc", "contact.full_name", "contact.email", count("skill_groups").alias("n_groups"), count("experience").alias("n_entries"), count(F.filter("experience", lambda e: e["dates"]["current"])).alias("n_current"))


# ---- bullets and answers ---------------------------------------------------------------------------------------

_BULLET = {"a": Pick(["Built React dashboards used by 40% of clients", "Maintained build servers and release tooling", "x", "Jane Doe | Engineer | Toronto, Canada", "Wrote long documents about many things and places", "see github.com/jane for more of my work and code", "Mentored 12 developers and led weekly reviews", "+1 416 555 0199 please call me any time at all", "A line of few but very extraordinary syllables"], 1), "b": Pick(["", " for Canada", " with GraphQL and TypeScript"], 1, 1)}
_JOB = {"d": Pick(["React dashboards for clients", "Release tooling, build servers and code reviews", "Write documents for many places", "", "GraphQL developers with TypeScript"], 1)}


def _tailorable(x: str) -> str:
    done = rf"regexp_matches({x}, '(?i)\b(?:{_DONE})\b')"
    parts = f"list_transform(string_split({x}, '|'), lambda p: length(trim(p)))"
    return rf"""(length({x}) >= 28 AND NOT regexp_matches({x}, '@\w+\.\w+|(?i:\b(linkedin\.com|github\.com|portfolio)\b)|^\+?[0-9][0-9\s().-]{{7,}}[0-9]$|^\(?[0-9]{{3}}\)?[-.\s]?[0-9]{{3}}[-.\s]?[0-9]{{4}}$|^(?i:https?://|www\.)|^(?i:resume|curriculum vitae|cv)$')
    AND NOT (NOT {done} AND len(string_split_regex({x}, '\s+')) < 8) AND NOT (len({parts}) >= 2 AND list_max({parts}) < 40 AND NOT {done}))"""


@query(
    rf"""WITH b AS (SELECT id % 40 AS user, id AS pos, a || b AS text FROM ({made_sql(_BULLET, "part", "p_partkey")})), j AS (SELECT id AS job, id % 40 AS user, d FROM ({made_sql(_JOB)})),
    s AS (SELECT job, pos, len(list_filter(string_split_regex(lower(text), '\W+'), lambda w: length(w) > 3 AND contains(lower(d), w))) + CASE WHEN regexp_matches(text, '(?i)\b(?:{_DONE})\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]+%|[0-9]+x|\$[0-9]|#[0-9]|[0-9]+\+') THEN 1 ELSE 0 END AS points FROM j JOIN b USING (user) WHERE {_tailorable("text")})
    SELECT job, rank, pos, points FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY points DESC, pos) AS rank FROM s) WHERE rank <= 8"""
)
def tailoring_top(spark, sf_dir):
    b = made(spark, sf_dir, _BULLET, "part", "p_partkey").select((F.col("id") % 40).alias("user"), F.col("id").alias("pos"), F.concat("a", "b").alias("text"))
    j = made(spark, sf_dir, _JOB).select(F.col("id").alias("job"), (F.col("id") % 40).alias("user"), F.col("d").alias("description"))
    return resume.tailoring_bullets(b, j).select("job", "rank", "pos", "points")


_ANSWER = {
    "answer": Pick(["I have 9 years of experience with AWS. I led the React rewrite.", "I managed a group of people that shipped GraphQL services and a lot of other things to clients in many places! Also java.", "No claims here.", "3+ years experience; built node.js tools", "Architected python and kubernetes systems, led it"], 1),
    "evidence": Pick(["Led the React rewrite", "9 years of experience in all", "Managed a group of p", "python, aws and react", ""], 1, 1),
    "job": Pick(["React and AWS", "GraphQL, Java and Kubernetes; GraphQL", "NodeJS or node.js", "Python"], 1, 2),
}


@query(
    rf"""WITH a AS (SELECT *, list_concat(regexp_extract_all(answer, '(?i)\b[0-9]+\+?\s*years?\s+(?:of\s+)?experience\b'), regexp_extract_all(answer, '(?i)\b(?:led|managed|architected|built|shipped)\b[^.!?]{{0,80}}')) AS said, regexp_extract_all(lower(job), '\b(?:react|typescript|graphql|kubernetes|java|python|aws|node\.?js)\b') AS asked FROM ({made_sql(_ANSWER)})),
    o AS (SELECT id, list_concat(list_transform(list_filter(list_transform(said, lambda c: trim(c)), lambda c: length(c) > 8 AND NOT contains(lower(evidence), lower(c)[1:20])), lambda c: 'Verify claim: "' || c[1:60] || CASE WHEN length(c) > 60 THEN '…' ELSE '' END || '"'),
    list_transform(list_filter(asked, lambda t, i: list_position(asked, t) = i AND contains(lower(answer), t) AND NOT contains(lower(evidence), t)), lambda t: '"' || t || '" mentioned in answer but not in cited evidence'))[1:5] AS claims FROM a)
    SELECT id, array_to_string(claims, '; ') AS claims FROM o"""
)
def claims_check(spark, sf_dir):
    d = made(spark, sf_dir, _ANSWER)
    return d.select("id", F.array_join(resume_lines.unsupported_claims(F.col("answer"), F.col("evidence"), F.col("job")), "; ").alias("claims"))
