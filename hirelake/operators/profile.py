"""A parsed resume as rows of a profile, how well it was parsed, and drafts of answers that cite its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.resume_lines import unsupported_claims
from hirelake.functions.skills import constant, technologies
from hirelake.functions.text import trim_blank

# Names of skill categories, and the categories of some skills.
CATEGORIES = {
    "language": "language", "languages": "language", "framework": "framework", "frameworks": "framework", "library": "library", "libraries": "library", "testing": "testing", "test": "testing",
    "platform": "platform", "architecture": "architecture", "accessibility": "accessibility", "a11y": "accessibility", "performance": "performance", "process": "process", "domain": "domain",
}
SKILL_CATEGORIES = {
    "react": "framework", "next.js": "framework", "nextjs": "framework", "typescript": "language", "javascript": "language", "node": "platform", "node.js": "platform", "graphql": "architecture",
    "playwright": "testing", "vitest": "testing", "tailwind": "framework", "redux": "library", "zustand": "library", "firebase": "platform",
}


def skill_category(category: Column, name: Column) -> Column:
    """The category that is named, else that of the skill, else domain."""
    key = lambda c: trim_blank(F.lower(c))
    return F.coalesce(F.try_element_at(constant(CATEGORIES), key(category)), F.try_element_at(constant(SKILL_CATEGORIES), key(name)), F.lit("domain"))


def row_id(*parts: Column) -> Column:
    """The id of a row, from its profile, kind and places: a second import gives the same ids."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 32)


def profile_rows(resumes: DataFrame) -> dict[str, DataFrame]:
    """The tables of a profile. resumes: profile_id, skill_groups (category, skills), experience (company, title, start, end,
    location, achievements, technologies) and projects (name, description, technologies). Bullets and projects with a
    description are evidence too, under the id of the row they come from."""
    p = F.col("profile_id")
    groups = resumes.select(p, F.posexplode("skill_groups").alias("group", "g")).select(p, "group", "g.category", F.posexplode("g.skills").alias("pos", "name"))
    skills = groups.select(row_id(p, F.lit("skill"), F.col("group"), F.col("pos")).alias("id"), p, "group", "pos", "name", skill_category(F.coalesce("category", F.lit("other")), F.col("name")).alias("category"))
    e = resumes.select(p, F.posexplode("experience").alias("entry", "e")).select(p, "entry", "e.*").withColumn("id", row_id(p, F.lit("experience"), F.col("entry")))
    experiences = e.select("id", p, "entry", F.coalesce("company", F.lit("Unknown")).alias("company"), F.coalesce("title", F.lit("Role")).alias("title"), "start", "end", "location")
    none = F.array().cast("array<string>")
    b = e.select(F.col("id").alias("experience_id"), p, "entry", F.coalesce("technologies", none).alias("_techs"), F.posexplode("achievements").alias("pos", "text"))
    named = F.array_distinct(F.concat(technologies(F.col("text")), F.transform("_techs", F.lower)))
    bullets = b.select(row_id(p, F.lit("bullet"), F.col("entry"), F.col("pos")).alias("id"), "experience_id", p, "entry", "pos", "text", named.alias("skills"))
    q = resumes.select(p, F.posexplode("projects").alias("entry", "q")).select(p, "entry", "q.*")
    projects = q.select(row_id(p, F.lit("project"), F.col("entry")).alias("id"), p, "entry", "name", "description", F.coalesce("technologies", none).alias("skills"))
    shown = projects.filter(F.coalesce("description", F.lit("")) != "").select(F.lit("project").alias("source_type"), F.col("id").alias("source_id"), p, "entry", F.lit(0).alias("pos"), F.col("description").alias("text"), F.transform("skills", F.lower).alias("skills"))
    evidence = bullets.select(F.lit("resume_bullet").alias("source_type"), F.col("id").alias("source_id"), p, "entry", "pos", "text", "skills").unionByName(shown)
    return {"skills": skills, "experiences": experiences, "bullets": bullets, "projects": projects, "evidence": evidence}


def evaluated(parsed: DataFrame, expectations: DataFrame) -> DataFrame:
    """Whether each expectation (doc, kind, value) holds. parsed: doc, summary, categories, skills, companies, titles,
    achievements, certifications, institutions (arrays) and contact (a map of fields). kind: one of these in the singular,
    not_achievement, or contact.<field>. Texts hold a value if they contain it, whatever its case; skills must equal it."""
    d = expectations.join(parsed, "doc")
    value = F.lower("value")
    holds = lambda c: F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), value)), F.lit(False))
    lists = {"skill_category": "categories", "company": "companies", "title": "titles", "achievement": "achievements", "certification": "certifications", "institution": "institutions"}
    kind = F.col("kind")
    passed = F.when(kind == "summary", F.contains(F.lower("summary"), value)).when(kind == "skill", F.exists("skills", lambda x: F.lower(x) == value)).when(kind == "not_achievement", ~holds("achievements"))
    passed = passed.when(kind.startswith("contact."), F.contains(F.lower(F.try_element_at("contact", F.substring(kind, 9, 100))), value))
    for name, column in lists.items():
        passed = passed.when(kind == name, holds(column))
    return d.select("doc", "kind", "value", F.coalesce(passed, F.lit(False)).alias("passed"))


def evaluation(metrics: DataFrame) -> DataFrame:
    """One row per doc of evaluated(): all passed or not, and shares of what was expected; without any expectation of a
    kind its share is 0, that of contact fields 1."""
    share = lambda test, none: F.coalesce(F.try_divide(F.count_if(test & F.col("passed")), F.count_if(test)), F.lit(none))
    kind = F.col("kind")
    return metrics.groupBy("doc").agg(
        F.every("passed").alias("passed"),
        share(F.lit(True), 0.0).alias("sections"),
        share(kind == "company", 0.0).alias("entries"),
        share(kind == "achievement", 0.0).alias("achievements"),
        share(kind.startswith("contact."), 1.0).alias("contact"),
        share(kind == "skill", 0.0).alias("skills"),
    )


def validated_drafts(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """drafts (id, answer, evidence_ids, claims, description) with the evidence ids that exist, in their order, and the claims
    that it does not support: those stated, then those found, each once. evidence: id, text. A null answer is invalid."""
    ids = drafts.select(F.col("id").alias("draft"), F.posexplode("evidence_ids").alias("pos", "id"))
    found = ids.join(evidence.select("id", "text"), "id").groupBy("draft").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("_cited"))
    d = drafts.join(found, drafts["id"] == found["draft"], "left").drop("draft")
    cited = F.coalesce(F.array_join(F.transform("_cited", lambda x: x["text"]), " "), F.lit(""))
    claims = F.array_distinct(F.filter(F.concat(F.coalesce("claims", F.array().cast("array<string>")), unsupported_claims(F.col("answer"), cited, F.coalesce("description", F.lit("")))), lambda c: F.coalesce(c, F.lit("")) != ""))
    known = F.coalesce(F.transform("_cited", lambda x: x["id"]), F.array().cast(dict(drafts.dtypes)["evidence_ids"]))
    return d.select("id", F.coalesce("answer", F.lit("")).alias("answer"), known.alias("evidence_ids"), F.when(F.col("answer").isNull(), F.array(F.lit("Invalid draft format"))).otherwise(claims).alias("claims"))
