"""Queries on stored state: the registry under several writers, the parse cache, row policies, verification slots, and profiles
from malformed JSON. The SQL works each result out from the tables at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text
from hirelake.operators import coercion, imports, parse_cache, registry, resume, tailoring, verification
from hirelake.plans.catalog import _NAMED as _NAMED_ENTITIES
from hirelake.plans.catalog import _PLAIN, query, table
from hirelake.plans.derived import Pick, quoted
from hirelake.plans.match_catalog import _techs
from hirelake.plans.posting_catalog import _BULLET, _DONE, _JOB, _tailorable, made, made_sql
from hirelake.sources import policies
from hirelake.sources.shared import shared_folder, stored
from hirelake.sources.versions import Versions

# ---- registry --------------------------------------------------------------------------------------------------

_PROVIDERS = ["lever", "ashby", "greenhouse"]
#: batches of candidates: table, key, boards that its keys are dealt to
_BATCHES = [("supplier", "s_suppkey", "s_name", 10_000_000, "Board"), ("customer", "c_custkey", "c_name", 130, "board"), ("part", "p_partkey", "p_name", 170, "BOARD")]


def _batch(spark, sf_dir, name: str, key: str, label: str, boards: int, word: str):
    k = F.col(key)
    b = k % boards
    of = lambda test, v: F.when(test, v).cast("string")
    provider = F.get(F.array(*map(F.lit, _PROVIDERS)), (b % 3).cast("int"))
    return table(spark, sf_dir, name).select(
        provider.alias("provider"), F.concat(F.lit(f"{word}-"), b.cast("string")).alias("slug"), k.cast("long").alias("pos"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col(label))).alias("name"), F.lit(None).cast("string").alias("url"),
        F.when(k % 3 == 0, F.array(F.lit("remote-canada"), F.concat(F.lit("tag"), (k % 7).cast("string")))).alias("industries"),
        of(k % 2 == 0, F.concat(F.lit("http://w"), k.cast("string"))).alias("website"), of(k % 4 == 1, F.concat(F.lit("http://c"), k.cast("string"))).alias("careers_url"),
        of(k % 3 == 1, F.concat(F.lit("country"), (k % 9).cast("string"))).alias("country"), of(k % 7 > 2, F.lit(name)).alias("discovery_source"),
    )


def _batch_sql(n: int, name: str, key: str, label: str, boards: int, word: str) -> str:
    return f"""SELECT {n} AS batch, {_PROVIDERS}[CAST({key} % {boards} % 3 AS INTEGER) + 1] AS provider, '{word}-' || {key} % {boards} AS slug, {key} AS pos, CASE {key} % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE trim({label}) END AS name,
    CASE WHEN {key} % 3 = 0 THEN 'tag' || {key} % 7 END AS industries, CASE WHEN {key} % 2 = 0 THEN 'http://w' || {key} END AS website, CASE WHEN {key} % 4 = 1 THEN 'http://c' || {key} END AS careers_url,
    CASE WHEN {key} % 3 = 1 THEN 'country' || {key} % 9 END AS country, CASE WHEN {key} % 7 > 2 THEN '{name}' END AS discovery_source FROM {name}"""


_LAST = ", ".join(f"arg_max({c}, batch) FILTER ({c} IS NOT NULL) AS {c}" for c in ("name", "industries", "website", "careers_url", "country", "discovery_source"))


@query(
    f"""WITH c AS ({" UNION ALL ".join(_batch_sql(n, *b) for n, b in enumerate(_BATCHES))}),
    d AS (SELECT * FROM c WHERE NOT regexp_matches(slug, '^[0-9a-fA-F]{{8,}}$') QUALIFY row_number() OVER (PARTITION BY batch, provider, lower(slug) ORDER BY pos) = 1),
    m AS (SELECT provider, lower(slug) AS key, arg_max(slug, batch) AS slug, arg_min(slug, batch) AS first, {_LAST} FROM d GROUP BY ALL)
    SELECT CASE WHEN provider = 'greenhouse' THEN key ELSE provider || '-' || key END AS id, provider, slug, coalesce(name, upper(first[1]) || first[2:5] || ' ' || first[7:]) AS name,
    CASE provider WHEN 'lever' THEN 'https://jobs.lever.co/' WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' ELSE 'https://boards.greenhouse.io/' END || slug AS url,
    coalesce(industries, '') AS industries, website, careers_url, country, discovery_source, 'verification_failed' AS status, true AS enabled FROM m"""
)
def registry_upsert(spark, sf_dir):
    """Three writers one after the other; the second is overtaken by the third and merges its batch anew."""
    store = Versions(spark, shared_folder(spark, "registry"), 16)
    first, second, third = (_batch(spark, sf_dir, *b) for b in _BATCHES)
    registry.upsert(store, first)
    registry.upsert(store, second)
    registry.upsert(store, third)
    d = store.read("registry")
    return d.select("id", "provider", "slug", "name", "url", F.array_join("industries", ",").alias("industries"), "website", "careers_url", "country", "discovery_source", "status", "enabled")


# ---- parse cache -----------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT doc_id, source AS usr, substr(sha256(text), 1, 32) AS h FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    e AS (SELECT usr, h, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, doc_id AS created, 'parsed ' || doc_id AS parsed FROM d WHERE doc_id % 4 <> 1),
    n AS (SELECT usr, h, version, max(created) AS created, arg_max(parsed, created) AS parsed FROM e GROUP BY ALL)
    SELECT d.doc_id, a.parsed AS parsed_v1, b.parsed AS parsed_v2, CASE WHEN b.parsed IS NOT NULL THEN 'hit' WHEN a.parsed IS NOT NULL THEN 'other version' ELSE 'miss' END AS outcome
    FROM d LEFT JOIN n a ON a.usr = d.usr AND a.h = d.h AND a.version = 'v1' LEFT JOIN n b ON b.usr = d.usr AND b.h = d.h AND b.version = 'v2'"""
)
def cached_parses(spark, sf_dir):
    """What was parsed before, for all documents: entries of the version asked for are hits, the same content under another is not."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND text IS NOT NULL")
    d = docs.select("doc_id", F.col("source").alias("user"), F.substring(F.sha2("text", 256), 1, 32).alias("hash"))
    path = shared_folder(spark, "parses")
    cache = parse_cache.ParseCache(spark, "parses_" + path[-32:], path, 16)
    version = F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1")
    old = d.filter(F.col("doc_id") % 4 != 1).select("user", "hash", version.alias("version"), F.col("doc_id").alias("created"), F.concat(F.lit("parsed "), F.col("doc_id").cast("string")).alias("parsed"))
    cache.add(old)
    first = cache.look_up(d, "v1").withColumnRenamed("parsed", "parsed_v1").drop("created")
    both = cache.look_up(first, "v2").withColumnRenamed("parsed", "parsed_v2")
    outcome = F.when(F.col("parsed_v2").isNotNull(), "hit").when(F.col("parsed_v1").isNotNull(), "other version").otherwise("miss")
    return both.select("doc_id", "parsed_v1", "parsed_v2", outcome.alias("outcome"))


# ---- policies --------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT * FROM orders WHERE o_custkey = 7), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o
    UNION ALL SELECT 'lineitem', count(*), sum(l_partkey)::BIGINT FROM l UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::BIGINT FROM nation"""
)
def row_policies(spark, sf_dir):
    """What one user sees of tables that are owned, owned through another table, and open."""
    rules = policies.Policies().owned("customer", "c_custkey").owned("orders", "o_custkey").through("lineitem", "l_orderkey", "orders", "o_orderkey").open("nation")
    rules.install(spark, {name: table(spark, sf_dir, name) for name in rules.rules})
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_partkey", "nation": "n_nationkey"}
    with policies.as_user(spark, 7):
        parts = [spark.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(k).cast("long").alias("keys")) for name, k in keys.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# ---- verification ----------------------------------------------------------------------------------------------

_ANSWERS = Pick(["Request timed out", None, "HTTP 404", "Board not found", "429", "Rate limit hit", "socket closed", None], 1)
_WHO = Pick(["greenhouse", "lever", "ashby", "lever", "other", "greenhouse"], 1, 1)


@query(
    f"""WITH b AS (SELECT o_orderkey AS id, {_WHO.sql("o_orderkey")} AS provider, {_ANSWERS.sql("o_orderkey")} AS error, o_orderkey % 3 AS jobs FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY id) - 1 AS n FROM b WHERE id % 10 <> 0 AND provider <> 'other')
    SELECT id, provider, CAST(n // CASE provider WHEN 'greenhouse' THEN 20 WHEN 'lever' THEN 15 ELSE 5 END AS BIGINT) AS slot, CAST(n // CASE provider WHEN 'greenhouse' THEN 20 WHEN 'lever' THEN 15 ELSE 5 END * CASE provider WHEN 'greenhouse' THEN 150 WHEN 'lever' THEN 200 ELSE 400 END AS BIGINT) AS start_ms,
    CASE WHEN error = 'Request timed out' THEN 'unavailable' WHEN error IN ('HTTP 404', 'Board not found') THEN 'invalid' WHEN error IN ('429', 'Rate limit hit') THEN 'rate_limited' WHEN error IS NOT NULL THEN 'verification_failed' WHEN jobs = 0 THEN 'empty' ELSE 'verified' END AS status FROM r"""
)
def verification_slots(spark, sf_dir):
    """Slots and outcomes of a verification that goes on after a tenth of the boards is done."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _WHO.column("o_orderkey").alias("provider"), _ANSWERS.column("o_orderkey").alias("error"), (F.col("o_orderkey") % 3).alias("jobs"))
    planned = verification.schedule(d, d.filter("id % 10 = 0").select("id"))
    return planned.select("id", "provider", "slot", "start_ms", verification.status(F.col("error"), F.col("jobs"), F.col("provider")).alias("status"))


# ---- malformed profiles ----------------------------------------------------------------------------------------

_JSON = {
    "name": Pick(['"Ada #"', "null", "7", '["x"]', '"  "'], 1),
    "place": Pick(['"Toronto"', "null", "{}", '"Town #"'], 3, 1),
    "skills": Pick(['["React", " ", 7, {"name": "Go #", "category": "languages"}]', "null", '"React"', '[{"name": 5, "category": "x"}, {"name": " "}, {"category": "y"}, "Vue #"]', "[]", '[{"name": "SQL", "category": 3}]'], 1, 2),
    "jobs": Pick(['[{"company": " Acme # ", "title": "Lead", "startDate": "2019", "endDate": "Present", "bullets": ["Did # things", 4, " "]}]', '[{"company": 3, "title": " ", "bullets": "one"}, 5]', "{}", '[{"title": "Engineer #", "endDate": 2020, "bullets": {"a": 1}}, {"company": "Beta"}]', "null"], 1, 1),
    "titles": Pick(['["Engineer", 1, ""]', '"Lead #"', "3", "null", '["Dev #"]'], 7),
    "end": Pick(["}", "}", "}", "}", "", "}", "}"], 1),
}
_J = "CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t::JSON END"


def _strict(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN {x} ->> '$' END"


def _bad(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}) NOT IN ('NULL', 'VARCHAR') THEN {path} END"


@query(
    rf"""WITH t AS (SELECT id, replace('{{"displayName": ' || name || ', "location": ' || place || ', "skills": ' || skills || ', "experiences": ' || jobs || ', "targetTitles": ' || titles || "end", '#', id::VARCHAR) AS t FROM ({made_sql(_JSON, 'orders', 'o_orderkey')})),
    j AS (SELECT id, {_J} AS j FROM t),
    f AS (SELECT id, j, j -> 'skills' AS s, j -> 'experiences' AS e, j -> 'targetTitles' AS w FROM j),
    l AS (SELECT *, CASE WHEN json_type(s) = 'ARRAY' THEN s::JSON[] ELSE [] END AS ss, CASE WHEN json_type(e) = 'ARRAY' THEN e::JSON[] ELSE [] END AS es, CASE json_type(w) WHEN 'ARRAY' THEN w::JSON[] WHEN 'VARCHAR' THEN [w] ELSE [] END AS ws FROM f),
    x AS (SELECT *, list_transform(es, lambda v: CASE json_type(v -> 'bullets') WHEN 'ARRAY' THEN (v -> 'bullets')::JSON[] WHEN 'VARCHAR' THEN [v -> 'bullets'] ELSE [] END) AS bs FROM l)
    SELECT id, {_strict("(j -> 'displayName')")} AS display_name, {_strict("(j -> 'location')")} AS location,
    array_to_string(list_filter(list_transform(ss, lambda v: CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' || '/' WHEN 'OBJECT' THEN {_strict("(v -> 'name')")} || '/' || coalesce({_strict("(v -> 'category')")}, '') END), lambda v: trim(split_part(v, '/', 1)) <> ''), ',') AS skills,
    array_to_string(list_filter(list_transform(es, lambda v, i: CASE WHEN json_type(v) = 'OBJECT' AND trim(coalesce({_strict("(v -> 'company')")}, '')) || trim(coalesce({_strict("(v -> 'title')")}, '')) <> '' THEN trim(coalesce({_strict("(v -> 'company')")}, '')) || '/' || trim(coalesce({_strict("(v -> 'title')")}, '')) || '/' || coalesce({_strict("(v -> 'startDate')")}, '') || '/' || coalesce({_strict("(v -> 'endDate')")}, '') || '/'
        || array_to_string(list_filter(list_transform(bs[i], lambda b: trim({_strict("b")})), lambda b: b <> ''), '+') || CASE WHEN coalesce(contains(lower({_strict("(v -> 'endDate')")}), 'present'), false) THEN '/now' ELSE '' END END), lambda v: v IS NOT NULL), ',') AS experiences,
    array_to_string(list_filter(list_transform(ws, lambda v: {_strict("v")}), lambda v: trim(v) <> ''), ',') AS target_titles,
    array_to_string(list_filter(list_concat([CASE WHEN j IS NULL THEN '$' END, {_bad("(j -> 'displayName')", "'displayName'")}, {_bad("(j -> 'location')", "'location'")}, CASE WHEN json_type(s) NOT IN ('NULL', 'ARRAY') THEN 'skills' END, CASE WHEN json_type(e) NOT IN ('NULL', 'ARRAY') THEN 'experiences' END, CASE WHEN json_type(w) NOT IN ('NULL', 'ARRAY', 'VARCHAR') THEN 'targetTitles' END],
        list_transform(ss, lambda v, i: CASE WHEN json_type(v) = 'OBJECT' THEN CASE WHEN coalesce(json_type(v -> 'name'), '') <> 'VARCHAR' THEN 'skills[' || i - 1 || '].name' END WHEN json_type(v) <> 'VARCHAR' THEN 'skills[' || i - 1 || ']' END),
        flatten(list_transform(es, lambda v, i: CASE WHEN json_type(v) = 'OBJECT' THEN [{", ".join(_bad(f"(v -> '{c}')", f"'experiences[' || i - 1 || '].{c}'") for c in ("company", "title", "startDate", "endDate"))}, CASE WHEN json_type(v -> 'bullets') NOT IN ('NULL', 'ARRAY', 'VARCHAR') THEN 'experiences[' || i - 1 || '].bullets' END, CASE WHEN len(list_filter(bs[i], lambda b: json_type(b) <> 'VARCHAR')) > 0 THEN 'experiences[' || i - 1 || '].bullets[]' END] ELSE ['experiences[' || i - 1 || ']'] END)),
        list_transform(ws, lambda v, i: CASE WHEN json_type(v) <> 'VARCHAR' THEN 'targetTitles[' || i - 1 || ']' END)), lambda v: v IS NOT NULL), ',') AS errors FROM x"""
)
def coerced_profiles(spark, sf_dir):
    """Malformed records: every field by the type it has, and the paths of those that don't fit."""
    d = made(spark, sf_dir, _JSON, "orders", "o_orderkey")
    text = F.concat(F.lit('{"displayName": '), "name", F.lit(', "location": '), "place", F.lit(', "skills": '), "skills", F.lit(', "experiences": '), "jobs", F.lit(', "targetTitles": '), "titles", "end")
    p = coercion.sanitised(coercion.coerced(d.select("id", F.replace(text, F.lit("#"), F.col("id").cast("string")).alias("text"))))
    r = coercion.as_resume(p).select("id", "experience").join(p, "id")
    skills = F.transform("skills", lambda s: F.concat(s["name"], F.lit("/"), F.coalesce(s["category"], F.lit(""))))
    jobs = F.transform("experience", lambda e: F.concat(e["company"], F.lit("/"), e["title"], F.lit("/"), F.coalesce(e["start"], F.lit("")), F.lit("/"), F.coalesce(e["end"], F.lit("")), F.lit("/"), F.array_join(e["achievements"], "+"), F.when(e["current"], "/now").otherwise("")))
    return r.select("id", "display_name", "location", F.array_join(skills, ",").alias("skills"), F.array_join(jobs, ",").alias("experiences"), F.array_join("target_titles", ",").alias("target_titles"), F.array_join("errors", ",").alias("errors"))


# ---- tailoring -------------------------------------------------------------------------------------------------

_NAMED, _UNNAMED = (quoted(x).replace("{}", "' || {} || '") for x in (tailoring.NAMED, tailoring.UNNAMED))
_UUID = "substr(md5({}), 1, 8) || '-' || substr(md5({}), 9, 4) || '-' || substr(md5({}), 13, 4) || '-' || substr(md5({}), 17, 4) || '-' || substr(md5({}), 21, 12)"
_RANKED = rf"""b AS (SELECT id % 40 AS usr, id AS pos, a || b AS text FROM ({made_sql(_BULLET, "part", "p_partkey")})), j AS (SELECT id AS job, id % 40 AS usr, d || ' for client ' || id AS d FROM ({made_sql(_JOB)})),
    s AS (SELECT job, pos, text, len(list_filter(string_split_regex(lower(text), '\W+'), lambda w: length(w) > 3 AND contains(lower(d), w))) + CASE WHEN regexp_matches(text, '(?i)\b(?:{_DONE})\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]+%|[0-9]+x|\$[0-9]|#[0-9]|[0-9]+\+') THEN 1 ELSE 0 END AS points FROM j JOIN b USING (usr) WHERE {_tailorable("text")}),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY points DESC, pos) AS rank FROM s) WHERE rank <= 8)"""


def _uuid(key):
    h = F.md5(key)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _ranked(spark, sf_dir):
    b = made(spark, sf_dir, _BULLET, "part", "p_partkey").select((F.col("id") % 40).alias("user"), F.col("id").alias("pos"), F.concat("a", "b").alias("text"))
    j = made(spark, sf_dir, _JOB).select(F.col("id").alias("job"), (F.col("id") % 40).alias("user"), F.concat("d", F.lit(" for client "), F.col("id").cast("string")).alias("description"))
    # read several times
    ranked = stored(spark, resume.tailoring_bullets(b, j).select("job", "rank", "pos", "text"), "ranked")
    return ranked.select("job", "rank", "pos", _uuid(F.col("pos").cast("string")).alias("id"), "text"), j


@query(
    rf"""WITH {_RANKED}, t AS (SELECT job, {_techs("d")}[1:6] AS asked FROM j), h AS (SELECT k.*, asked, list_filter(asked, lambda x: contains(lower(text), lower(x))) AS has FROM k JOIN t USING (job) WHERE rank <= 5)
    SELECT job, rank, pos, text || CASE WHEN len(has) > 0 THEN {_NAMED.format("array_to_string(has, ', ')")} ELSE {_UNNAMED.format("array_to_string(asked[1:3], ', ')")} END AS suggested, CASE WHEN len(has) > 0 THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM h WHERE len(asked) > 0"""
)
def tailoring_suggestions(spark, sf_dir):
    ranked, jobs = _ranked(spark, sf_dir)
    return tailoring.suggestions(ranked, jobs).select("job", "rank", "pos", "suggested", F.col("confidence").cast("double").alias("confidence"))


_RAW = {"type": Pick(["emphasize", None, "rewrite", "reorder"], 1), "shift": Pick(["0", "0", "1", "0", "0"], 1, 2), "end": Pick(["", " better", "", " with numbers", " "], 1, 1), "sure": Pick(["0.5", "0.9", "1", "0.2"], 1)}
_BROKEN = "job % 13 = 0 AND rank = 2"


@query(
    rf"""WITH {_RANKED}, r AS (SELECT job, rank, text, {", ".join(f"{p.sql('(job + rank * 7)')} AS {n}" for n, p in _RAW.items())}, pos FROM k),
    w AS (SELECT *, CASE WHEN {_BROKEN} THEN 'x' ELSE {_UUID.replace("{}", "(pos + shift::INTEGER * 100000)::VARCHAR")} END AS bullet_id, CASE WHEN (job + rank) % 6 = 0 THEN rank % 2 END AS ev FROM r),
    ok AS (SELECT * FROM w WHERE job NOT IN (SELECT job FROM w WHERE bullet_id = 'x'))
    SELECT job, rank, coalesce(type, 'rewrite') AS type, text AS original, text || "end" AS suggested, sure::DOUBLE AS confidence FROM ok WHERE shift = '0' AND (ev IS NULL OR ev = 0) AND NOT (coalesce(type, 'rewrite') = 'emphasize' AND trim("end") = '')"""
)
def tailoring_checked(spark, sf_dir):
    """Suggestions of which some name bullets or evidence that the posting has not, change nothing, or break the form."""
    ranked, _ = _ranked(spark, sf_dir)
    d = ranked.withColumn("_k", F.col("job") + F.col("rank") * 7)
    d = d.withColumns({n: p.column("_k") for n, p in _RAW.items()})
    bullet = F.when(F.expr(_BROKEN), "x").otherwise(_uuid((F.col("pos") + F.col("shift").cast("int") * 100_000).cast("string")))
    ev = F.when((F.col("job") + F.col("rank")) % 6 == 0, _uuid(F.concat(F.lit("e"), (F.col("rank") % 2).cast("string"))))
    raw = d.select("job", F.col("rank").alias("pos"), "type", bullet.alias("bullet_id"), F.lit("what was said").alias("original"), F.concat("text", "end").alias("suggested"), ev.alias("evidence_id"), F.col("sure").cast("double").alias("confidence"))
    evidence = ranked.select("job").distinct().withColumn("id", _uuid(F.lit("e0")))
    ok = tailoring.validated(raw, ranked.select("job", "id", "text"), evidence)
    return ok.select("job", F.col("pos").alias("rank"), "type", "original", "suggested", "confidence")


@query(
    rf"""WITH {_RANKED}, e AS (SELECT k.job, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS source, text AS said FROM (SELECT DISTINCT job FROM k) k JOIN b ON true JOIN part ON p_partkey = b.pos WHERE b.usr = k.job % 40 AND p_partkey % 2 = 1)
    SELECT job, id FROM e WHERE EXISTS (SELECT 1 FROM k WHERE k.job = e.job AND (k.pos = e.source OR k.text = e.said))"""
)
def tailoring_evidence(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir)
    ranked = ranked.select("job", (F.col("job") % 40).alias("user"), F.col("pos").alias("id"), "text")
    b = made(spark, sf_dir, _BULLET, "part", "p_partkey").select((F.col("id") % 40).alias("user"), "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("source_id"), F.concat("a", "b").alias("text")).filter("id % 2 = 1")
    return tailoring.linked_evidence(b, ranked, "user").select("job", "id")


# ---- postings from real pages ----------------------------------------------------------------------------------


@query(
    rf"""WITH p AS (SELECT page_id, {_PLAIN}[1:50000] AS t, nullif(regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1, 'i'), '') AS raw FROM pages),
    h AS (SELECT *, regexp_replace(string_split_regex({_NAMED_ENTITIES.format(x=r"regexp_replace(raw, '^\s+|\s+$', '', 'g')")}, '\s*[|\-–—]\s*')[1], '^\s+|\s+$', '', 'g') AS head FROM p),
    f AS (SELECT *, trim(regexp_extract(t, '(?i)(?:title|position|role)[:\s]+([^
]+)', 1)) AS named, trim(regexp_extract(t, '(?i)(?:company|organization)[:\s]+([^
]+)', 1)) AS firm, trim(regexp_extract(t, '(?i)location[:\s]+([^
]+)', 1)) AS place, trim(regexp_extract(t, '([^\s][^
]*)', 1)) AS line FROM h),
    c AS (SELECT *, regexp_replace(CASE WHEN length(head) BETWEEN 1 AND 120 THEN head WHEN named <> '' THEN named WHEN length(line) <= 120 THEN line ELSE '' END, '\s+', ' ', 'g') AS name FROM f)
    SELECT page_id, CASE WHEN length(name) BETWEEN 1 AND 120 THEN name ELSE 'Untitled Role' END AS title, CASE WHEN length(firm) BETWEEN 1 AND 120 THEN regexp_replace(firm, '\s+', ' ', 'g') ELSE 'Unknown Company' END AS company, nullif(place, '') AS location, CASE WHEN regexp_matches(t, '(?i)remote') THEN 'remote' ELSE 'unknown' END AS workplace, length(t) AS n_chars FROM c"""
)
def page_postings(spark, sf_dir):
    """Every stored web page as a posting."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.html_to_text(F.col("html")).alias("text"), text.html_title(F.col("html")).alias("page_title"))
    d = imports.from_page(pages)
    return d.select(F.col("id").alias("page_id"), "title", "company", "location", "workplace", F.length("description").alias("n_chars"))
