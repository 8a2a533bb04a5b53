"""Scoring postings against a candidate: hard filters, requirement matches, seven category scores and a summary.

A profile is one struct: years (int), remote_preference, preferred_locations, skills (names) and evidence
(array of id, text and skills, in a fixed order). Everything is one expression over a posting beside its profile,
so scoring shuffles nothing beyond the join that brings the two together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.skills import canonical_skill
from hirelake.functions.text import round_tenth
from hirelake.operators.requirements import skill_count

# The rubric.
WEIGHTS = {"core_skills": 25, "frameworks_tools": 15, "relevant_experience": 20, "responsibility_alignment": 15, "seniority_leadership": 10, "location_work_arrangement": 10, "education_domain": 5}
CORE = ["react", "typescript", "javascript"]
FRAMEWORKS = ["next.js", "tailwind", "graphql", "redux", "zustand", "mui", "shadcn", "apollo", "tanstack query", "node.js", "firebase"]
RELATED = {"vue": ["react", "javascript"], "angular": ["react", "typescript"], "cypress": ["playwright"]}
GAPS = ["java", "kubernetes", "k8s", "aws", "vue", "go", "rust", "c#"]
CLASSES = [(85, "excellent"), (75, "strong"), (60, "possible"), (45, "stretch")]
SPARSE_MOST, ONE_GAP_MOST, GAPS_MOST = 70, 55, 40


def skill_set(skills: Column, evidence: Column) -> Column:
    shown = F.flatten(F.transform(evidence, lambda e: e["skills"]))
    return F.array_distinct(F.transform(F.concat(skills, shown), canonical_skill))


def _texts(*pairs: tuple[Column, Column]) -> Column:
    """The texts whose condition holds."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for c, t in pairs)), lambda x: x.isNotNull())


def hard_filters(title: Column, location: Column, description: Column, workplace: Column, requirements: Column, profile: Column) -> Column:
    """struct(result, warnings, blocks): pass, warning or block."""
    none, loc = F.lit(""), F.lower(F.coalesce(location, F.lit("")))
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(location, none), F.lit(" "), F.coalesce(description, none)))
    onsite, years = F.coalesce(workplace == "on_site", F.lit(False)), F.coalesce(profile["years"], F.lit(0))
    city = (F.contains(loc, F.lit("san francisco")) | F.contains(loc, F.lit("new york"))) & ~F.coalesce(F.exists(profile["preferred_locations"], lambda p: F.contains(loc, F.lower(p))), F.lit(False)) & ~F.coalesce(workplace == "remote", F.lit(False))
    first = lambda test: F.get(F.filter(requirements, test), 0)["text"]
    asked = F.regexp_extract(first(lambda r: (r["type"] == "experience") & r["text"].rlike(r"(?i)\d+\+?\s*years?")), r"(?i)(\d+)\+?\s*years?", 1).try_cast("int")
    clearance = first(lambda r: r["type"] == "clearance")
    blocks = _texts(
        ((profile["remote_preference"] == "remote") & onsite, F.lit("Role is on-site but you prefer remote work")),
        (city, F.concat(F.lit("Role requires location in "), location)),
        (clearance.isNotNull(), F.concat(F.lit("Requires security clearance: "), clearance)),
    )
    level = F.lower(title).rlike("staff|principal")
    warnings = _texts(
        (~F.contains(text, F.lit("canada")) & onsite & ~F.contains(text, F.lit("remote")), F.lit("Role may not be Canada-based or remote")),
        (asked > years + 3, F.concat(F.lit("Role requires "), asked.cast("string"), F.lit("+ years; profile shows "), years.cast("string"))),
        (level & (years < 8), F.lit("Staff/principal level may exceed current seniority")),
    )
    result = F.when(F.size(blocks) > 0, "block").when(F.size(warnings) > 0, "warning").otherwise("pass")
    return F.struct(result.alias("result"), warnings.alias("warnings"), blocks.alias("blocks"))


def keyed(requirements: Column) -> Column:
    """The requirements with `key`, the canonical skill or null, so that it is worked out once."""
    return F.transform(requirements, lambda r: F.struct(*(r[c].alias(c) for c in ("type", "text", "skill", "importance", "hard")), F.nullif(canonical_skill(r["skill"]), F.lit("")).alias("key")))


def known_evidence(evidence: Column) -> Column:
    """The evidence with canonical skills and a lower-case text."""
    return F.transform(evidence, lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), F.lower(e["text"]).alias("low"), F.transform(e["skills"], canonical_skill).alias("skills")))


def requirement_match(r: Column, skills: Column, evidence: Column) -> Column:
    """struct(status, confidence, evidence_id, explanation) of one requirement of keyed(); the first rule that fits decides.
    skills: canonical names; evidence: from known_evidence()."""
    skill = r["key"]
    long_words = F.filter(F.split(r["text"], " "), lambda w: F.length(w) > 4)
    spoken = F.get(F.filter(evidence, lambda e: F.exists(long_words, lambda w: F.contains(e["low"], F.lower(w)))), 0)
    shown = F.get(F.filter(evidence, lambda e: F.array_contains(e["skills"], skill)), 0)
    related = F.try_element_at(F.create_map(*(x for k, v in RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), skill)
    overlap = F.exists(skills, lambda s: F.contains(skill, s) | F.contains(s, skill))

    def outcome(status: str, confidence: float, why: Column, evidence_id: Column | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), (F.lit(None).cast("string") if evidence_id is None else evidence_id).alias("evidence_id"), why.alias("explanation"))

    quoted = F.when(shown.isNotNull(), F.concat(F.lit('Confirmed: "'), F.substring(shown["text"], 1, 100), F.lit('"'))).otherwise(F.concat(F.lit("Skill "), skill, F.lit(" found in profile")))
    return (
        F.when((r["type"] == "location") & r["hard"], outcome("blocked", 0.9, F.concat(F.lit("Location requirement: "), r["text"])))
        .when(skill.isNull() & (r["type"] == "responsibility") & spoken.isNotNull(), outcome("confirmed", 0.7, F.concat(F.lit('Responsibility aligned with: "'), F.substring(spoken["text"], 1, 80), F.lit('..."')), spoken["id"]))
        .when(skill.isNull(), outcome("missing_evidence", 0.5, F.lit("No specific skill mapping for this requirement")))
        .when(F.array_contains(skills, skill), outcome("confirmed", 0.9, quoted, shown["id"]))
        .when(F.coalesce(F.arrays_overlap(related, skills), F.lit(False)), outcome("transferable", 0.6, F.concat(skill, F.lit(" not direct but related skills present ("), F.array_join(related, ", "), F.lit(")"))))
        .when(overlap, outcome("transferable", 0.5, F.concat(F.lit("Partial overlap with related skills for "), skill)))
        .when(skill.isin(GAPS), outcome("gap", 0.8, F.concat(F.lit("No evidence of "), skill, F.lit(" in profile — qualification gap"))))
        .otherwise(outcome("missing_evidence", 0.8, F.concat(skill, F.lit(" not documented in profile — may exist but not evidenced"))))
    )


def category_scores(title: Column, description: Column, workplace: Column, requirements: Column, matches: Column, skills: Column, profile: Column) -> dict[str, Column]:
    """The seven scores, each rounded to a tenth before they are added. requirements: from keyed()."""
    asked = F.filter(F.transform(requirements, lambda r: r["key"]), lambda s: s.isNotNull())

    def share(names: list[str], weight: int) -> Column:
        wanted = F.filter(asked, lambda s: s.isin(names))
        return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda s: F.array_contains(skills, s))) / F.size(wanted) * weight).otherwise(F.lit(0.0))

    both = F.zip_with(requirements, matches, lambda r, m: F.struct(r["type"].alias("type"), m["status"].alias("status")))
    count = lambda test: F.size(F.filter(both, test))
    confirmed, duties = count(lambda x: x["status"] == "confirmed"), count(lambda x: x["type"] == "responsibility")
    done = count(lambda x: (x["type"] == "responsibility") & (x["status"] == "confirmed"))
    years, senior = F.coalesce(profile["years"], F.lit(0)), F.lower(title).rlike("senior|staff")
    educated = (count(lambda x: x["type"] == "education") > 0) | F.coalesce(F.contains(F.lower(description), F.lit("degree")), F.lit(False))
    remote = F.coalesce((profile["remote_preference"] == "remote") & (workplace == "remote"), F.lit(False))
    raw = {
        "core_skills": share(CORE, WEIGHTS["core_skills"]),
        "frameworks_tools": share(FRAMEWORKS, WEIGHTS["frameworks_tools"]),
        "relevant_experience": confirmed / F.greatest(F.size(matches), F.lit(1)) * WEIGHTS["relevant_experience"],
        "responsibility_alignment": F.when(duties > 0, done / duties * WEIGHTS["responsibility_alignment"]).otherwise(F.lit(0.0)),
        "seniority_leadership": F.when(senior & (years >= 5), F.lit(10.0)).when(senior, F.lit(5.0)).otherwise(F.lit(8.0)),
        "location_work_arrangement": F.when(remote, F.lit(10.0)).when(workplace == "hybrid", F.lit(7.0)).otherwise(F.lit(4.0)),
        "education_domain": F.when(educated, F.lit(4.0)).otherwise(F.lit(0.0)),
    }
    return {k: round_tenth(v).cast("double") for k, v in raw.items()}


def classify(score: Column, result: Column) -> Column:
    return F.coalesce(F.when(result == "block", "poor"), *(F.when(score >= least, name) for least, name in CLASSES), F.lit("poor"))


def analyse(pairs: DataFrame) -> DataFrame:
    """pairs: title, location, description, workplace, requirements and profile. Adds filter, matches, scores (a struct),
    overall, classification, top_skills, top_concern and summary."""
    c = F.col
    d = pairs.withColumns({"_skills": skill_set(c("profile.skills"), c("profile.evidence")), "_reqs": keyed(c("requirements")), "_shown": known_evidence(c("profile.evidence"))})
    d = d.withColumn("filter", hard_filters(c("title"), c("location"), c("description"), c("workplace"), c("requirements"), c("profile")))
    d = d.withColumn("matches", F.transform("_reqs", lambda r: requirement_match(r, c("_skills"), c("_shown"))))
    scores = category_scores(c("title"), c("description"), c("workplace"), c("_reqs"), c("matches"), c("_skills"), c("profile"))
    d = d.withColumn("scores", F.struct(*(v.alias(k) for k, v in scores.items())))
    total = F.floor(reduce(lambda a, b: a + b, (c(f"scores.{k}") for k in WEIGHTS)) + 0.5).cast("int")
    both = F.zip_with("requirements", "matches", lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    d = d.withColumn("_both", both).withColumn("_gaps", F.size(F.filter("_both", lambda x: (x["m"]["status"] == "gap") & (x["r"]["importance"] == "required"))))
    sparse = (F.size("requirements") < 3) | (skill_count(c("requirements")) < 1)
    capped = F.least(total, F.when(sparse, F.lit(SPARSE_MOST)), F.when(c("_gaps") >= 2, F.lit(GAPS_MOST)).when(c("_gaps") == 1, F.lit(ONE_GAP_MOST)))
    d = d.withColumn("overall", capped).withColumn("classification", classify(c("overall"), c("filter.result"))).withColumn("_sparse", sparse)
    said = lambda test, n=1_000: F.slice(F.transform(F.filter("matches", test), lambda m: m["explanation"]), 1, n)
    d = d.withColumn("top_skills", F.slice(F.filter(F.transform(F.filter("_both", lambda x: x["m"]["status"] == "confirmed"), lambda x: x["r"]["skill"]), lambda s: F.coalesce(s, F.lit("")) != ""), 1, 5))
    d = d.withColumn("top_concern", F.coalesce(F.get(said(lambda m: m["status"].isin("gap", "blocked")), 0), F.get("filter.blocks", 0), F.get("filter.warnings", 0)))
    strong, gaps = said(lambda m: m["status"] == "confirmed", 2), said(lambda m: m["status"].isin("gap", "missing_evidence"), 2)
    lines = F.array(
        F.concat(F.lit("Overall match: "), c("overall").cast("string"), F.lit("% ("), c("classification"), F.lit(")")),
        F.when(c("_sparse"), F.lit("Limited requirement extraction — score may be unreliable")),
        F.when(F.size(strong) > 0, F.concat(F.lit("Strong: "), F.array_join(strong, "; "))),
        F.when(F.size(gaps) > 0, F.concat(F.lit("Gaps: "), F.array_join(gaps, "; "))),
    )
    return d.withColumn("summary", F.array_join(lines, ". ")).drop("_skills", "_reqs", "_shown", "_both", "_gaps", "_sparse")


def category_rows(analysed: DataFrame, key: str = "id") -> DataFrame:
    """Seven rows for each analysis: category, score and most."""
    rows = F.array(*(F.struct(F.lit(k).alias("category"), F.col(f"scores.{k}").alias("score"), F.lit(float(w)).alias("most")) for k, w in WEIGHTS.items()))
    return analysed.select(key, F.inline(rows))


def requirement_rows(analysed: DataFrame, key: str = "id") -> DataFrame:
    # an outer explode works the array out once; an inner one would do so again to see whether it is empty
    return analysed.select(key, F.posexplode_outer("matches").alias("pos", "m")).filter("pos is not null").select(key, "pos", "m.*")


def grouped_matches(matches: Column) -> Column:
    """struct of four arrays of explanations, by status."""
    of = lambda *names: F.transform(F.filter(matches, lambda m: m["status"].isin(*names)), lambda m: m["explanation"])
    return F.struct(of("confirmed").alias("confirmed"), of("transferable").alias("transferable"), of("missing_evidence").alias("missing_evidence"), of("gap", "blocked").alias("gaps"))
