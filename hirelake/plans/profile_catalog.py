"""Queries on profiles made from resumes, their evaluation and drafts of answers, with SQL that computes the same by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import profile
from hirelake.plans.catalog import query
from hirelake.plans.derived import Pick, quoted
from hirelake.plans.match_catalog import _techs
from hirelake.plans.posting_catalog import _ANSWER, made, made_sql

_SKILL = {"category": Pick(["Languages", None, " Test ", "cloud", "A11y", "frameworks"], 1), "name": Pick(["React", "Docker", " Node.js ", "redux", "French"], 1, 1)}


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


@query(f"SELECT id, coalesce({_map(profile.CATEGORIES)}[lower(trim(category))], {_map(profile.SKILL_CATEGORIES)}[lower(trim(name))], 'domain') AS category FROM ({made_sql(_SKILL, 'orders', 'o_orderkey')})")
def skill_categories(spark, sf_dir):
    return made(spark, sf_dir, _SKILL, "orders", "o_orderkey").select("id", profile.skill_category(F.col("category"), F.col("name")).alias("category"))


_PARSED = {
    "g1": Pick([["React", "Go"], [], ["TypeScript"]], 1),
    "c1": Pick(["Languages", None, "Tools"], 1, 1),
    "company": Pick(["Acme Inc", None, "Beta Co"], 1),
    "title": Pick([None, "Web Developer", "Lead"], 1, 1),
    "a1": Pick([["Built React apps", "Led a group"], [], ["Moved services to AWS with Docker"]], 5, 1),
    "t1": Pick([["GraphQL", "React"], None, ["AWS"]], 1, 1),
    "a2": Pick([["Wrote Python tools"], ["x", "y"]], 1),
    "project": Pick(["A site in Vue", None, ""], 1, 2),
    "summary": Pick(["Web person who builds", None, "Lead of teams"], 7),
    "wanted": Pick(["react", "aws", "web", "lead", "acme", "nothing"], 1),
}


def _resumes(spark, sf_dir):
    d = made(spark, sf_dir, _PARSED)
    none = F.lit(None).cast("string")
    entry = lambda company, title, a, t: F.struct(company.alias("company"), title.alias("title"), none.alias("start"), none.alias("end"), none.alias("location"), a.alias("achievements"), t.cast("array<string>").alias("technologies"))
    return d.select(
        F.col("id").alias("profile_id"),
        F.array(F.struct(F.col("c1").alias("category"), F.col("g1").alias("skills"))).alias("skill_groups"),
        F.array(entry(F.col("company"), F.col("title"), F.col("a1"), F.col("t1")), entry(F.lit("Gamma"), F.lit("Ops"), F.col("a2"), F.array().cast("array<string>"))).alias("experience"),
        F.array(F.struct(F.lit("p").alias("name"), F.col("project").alias("description"), F.array(F.lit("Vue")).alias("technologies"))).alias("projects"),
        "summary",
        "wanted",
    )


@query(
    f"""WITH r AS ({made_sql(_PARSED)}), b AS (SELECT id, 0 AS entry, unnest(a1) AS text, unnest(range(len(a1))) AS pos, coalesce(t1, []) AS more FROM r UNION ALL SELECT id, 1, unnest(a2), unnest(range(len(a2))), [] FROM r),
    s AS (SELECT id, 'resume_bullet' AS source_type, entry, pos, text, list_concat({_techs("text")}, list_transform(more, lambda x: lower(x))) AS skills FROM b UNION ALL SELECT id, 'project', 0, 0, project, ['vue'] FROM r WHERE project <> '')
    SELECT id AS profile_id, source_type, entry, pos, text, array_to_string(list_filter(skills, lambda x, i: list_position(skills, x) = i), ',') AS skills FROM s"""
)
def profile_evidence(spark, sf_dir):
    d = profile.profile_rows(_resumes(spark, sf_dir))["evidence"]
    return d.select("profile_id", "source_type", "entry", "pos", "text", F.array_join("skills", ",").alias("skills"))


@query(f"WITH r AS ({made_sql(_PARSED)}) SELECT id AS profile_id, unnest([coalesce(company, 'Unknown'), 'Gamma']) AS company, unnest([coalesce(title, 'Role'), 'Ops']) AS title, unnest([len(a1), len(a2)]) AS n_bullets FROM r")
def profile_experiences(spark, sf_dir):
    rows = profile.profile_rows(_resumes(spark, sf_dir))
    n = rows["bullets"].groupBy(F.col("experience_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows["experiences"].join(n, "id", "left").select("profile_id", "company", "title", F.coalesce("n", F.lit(0)).alias("n_bullets"))


_KINDS = ["summary", "skill_category", "skill", "company", "title", "achievement", "not_achievement", "contact.email"]


@query(
    f"""WITH r AS (SELECT *, list_concat(a1, a2) AS done FROM ({made_sql(_PARSED)})), m AS (SELECT id, unnest([coalesce(contains(lower(summary), wanted), false), coalesce(contains(lower(c1), wanted), false), len(list_filter(g1, lambda x: lower(x) = wanted)) > 0, coalesce(contains(lower(company), wanted), false) OR contains('gamma', wanted),
    coalesce(contains(lower(title), wanted), false) OR contains('ops', wanted), len(list_filter(done, lambda x: contains(lower(x), wanted))) > 0, len(list_filter(done, lambda x: contains(lower(x), wanted))) = 0, contains('web' || id || '@example.com', wanted)]) AS ok, unnest(range(8)) AS k FROM r)
    SELECT id AS doc, bool_and(ok) AS passed, count(*) FILTER (ok) / 8 AS sections, max(CASE WHEN k = 3 AND ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS entries, max(CASE WHEN k = 5 AND ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS achievements, max(CASE WHEN k = 7 AND ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS contact, max(CASE WHEN k = 2 AND ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS skills FROM m GROUP BY 1"""
)
def resume_evaluation(spark, sf_dir):
    r = _resumes(spark, sf_dir)
    of = lambda name: F.transform("experience", lambda e: e[name])
    none = F.array().cast("array<string>")
    parsed = r.select(
        F.col("profile_id").alias("doc"), "summary", F.transform("skill_groups", lambda g: g["category"]).alias("categories"), F.flatten(F.transform("skill_groups", lambda g: g["skills"])).alias("skills"), of("company").alias("companies"), of("title").alias("titles"),
        F.flatten(of("achievements")).alias("achievements"), none.alias("certifications"), none.alias("institutions"), F.create_map(F.lit("email"), F.concat(F.lit("web"), F.col("profile_id").cast("string"), F.lit("@example.com"))).alias("contact"),
    )
    wanted = r.select(F.col("profile_id").alias("doc"), F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"), F.col("wanted").alias("value"))
    return profile.evaluation(profile.evaluated(parsed, wanted))


@query(
    rf"""WITH a AS (SELECT id, answer, job, id % 4 AS k, [p_partkey_1, p_partkey_2, 0] AS ids FROM (SELECT *, id % 150 + 1 AS p_partkey_1, id % 70 + 1 AS p_partkey_2 FROM ({made_sql(_ANSWER)}))),
    c AS (SELECT id, string_agg(p_name, ' ' ORDER BY pos) AS cited, string_agg(p_partkey::VARCHAR, ',' ORDER BY pos) AS kept FROM (SELECT id, unnest(ids) AS i, unnest(range(3)) AS pos FROM a) JOIN part ON p_partkey = i GROUP BY id),
    s AS (SELECT a.*, lower(coalesce(cited, '')) AS cited, kept, list_concat(regexp_extract_all(answer, '(?i)\b[0-9]+\+?\s*years?\s+(?:of\s+)?experience\b'), regexp_extract_all(answer, '(?i)\b(?:led|managed|architected|built|shipped)\b[^.!?]{{0,80}}')) AS said, regexp_extract_all(lower(job), '\b(?:react|typescript|graphql|kubernetes|java|python|aws|node\.?js)\b') AS asked FROM a LEFT JOIN c USING (id)),
    o AS (SELECT id, kept, k, list_concat(['stated', '', 'stated'], list_concat(list_transform(list_filter(list_transform(said, lambda x: trim(x)), lambda x: length(x) > 8 AND NOT contains(cited, lower(x)[1:20])), lambda x: 'Verify claim: "' || x[1:60] || CASE WHEN length(x) > 60 THEN '…' ELSE '' END || '"'),
    list_transform(list_filter(asked, lambda t, i: list_position(asked, t) = i AND contains(lower(answer), t) AND NOT contains(cited, t)), lambda t: '"' || t || '" mentioned in answer but not in cited evidence'))[1:5]) AS claims FROM s)
    SELECT id, coalesce(kept, '') AS kept, CASE WHEN k = 0 THEN 'Invalid draft format' ELSE array_to_string(list_filter(claims, lambda x, i: x <> '' AND list_position(claims, x) = i), '; ') END AS claims FROM o"""
)
def draft_validation(spark, sf_dir):
    d = made(spark, sf_dir, _ANSWER)
    drafts = d.select("id", F.when(F.col("id") % 4 != 0, F.col("answer")).alias("answer"), F.array(F.col("id") % 150 + 1, F.col("id") % 70 + 1, F.lit(0).cast("long")).alias("evidence_ids"), F.array(F.lit("stated"), F.lit(""), F.lit("stated")).alias("claims"), F.col("job").alias("description"))
    evidence = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    found = profile.validated_drafts(drafts, evidence)
    return found.select("id", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("kept"), F.array_join("claims", "; ").alias("claims"))
