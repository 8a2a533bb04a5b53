"""Requirements of a posting: sections of its text, and typed requirement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.skills import canonical_skill, technologies
from hirelake.functions.text import once, trim_blank, word

# Headings of sections and phrases of requirement types.
REQUIRED_LINE = r"(?i)^(?:required|must have|minimum qualifications|qualifications|what you.?ll need|you have:?)\z"
REQUIRED_IN = r"(?i)required|must have|minimum qualifications|you have"
PREFERRED_LINE = r"(?i)^(?:preferred|nice to have|nice-to-have|bonus|plus:?)\z"
PREFERRED_IN = r"(?i)preferred|nice to have|bonus"
DUTIES_LINE = r"(?i)^(?:responsibilities|what you.?ll do|you.?ll do|what we.?re looking for you to do|your role)\z"
DUTIES_IN = r"(?i)responsibilit"
YEARS = r"(?i)\d+\+?\s*years?"
REQUIREMENT = "struct<type:string,text:string,skill:string,importance:string,hard:boolean>"


def section_of(line: Column) -> Column:
    """The section that a heading line opens; null for other lines."""
    t, short = trim_blank(line), F.length(line) < 60
    return F.when(
        F.length(line) <= 80,
        F.when(t.rlike(REQUIRED_LINE) | (t.rlike(REQUIRED_IN) & short), "required")
        .when(t.rlike(PREFERRED_LINE) | (t.rlike(PREFERRED_IN) & short), "preferred")
        .when(t.rlike(DUTIES_LINE) | (t.rlike(DUTIES_IN) & short), "responsibilities"),
    )


def sectioned(text: Column) -> Column:
    """pos, section and bullet of the lines of a text that belong to a section, an array. Lines take the last heading above them."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), trim_blank(x).alias("line"))), lambda x: x["line"] != "")
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), section_of(x["line"]).alias("head")))

    def parts(all_: Column) -> Column:
        """Each part is a slice: from a heading to the next, and before the first one."""
        heads = F.filter(F.transform(all_, lambda x, i: F.when(x["head"].isNotNull(), i + 1)), lambda i: i.isNotNull())

        def part(at: Column, start: Column, k: Column) -> Column:
            end, section = F.coalesce(F.get(at, k + 1), F.size(all_) + 1), F.get(all_, start - 1)["head"]
            return F.transform(F.slice(all_, start + 1, end - start - 1), lambda x: F.struct(x["pos"].alias("pos"), section.alias("section"), trim_blank(F.regexp_replace(x["line"], r"^[-•*]\s*", "")).alias("bullet")))

        return once(F.concat(F.array(F.lit(0)), heads), lambda at: F.flatten(F.transform(at, lambda start, k: part(at, start, k))))

    loose = lambda b: b.rlike(r"(?i)^\d+\+?\s*years?") | b.rlike("(?i)experience with")
    found = F.filter(once(lines, parts), lambda x: F.length(x["bullet"]) >= 10)
    found = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(x["section"], F.when(loose(x["bullet"]), "required")).alias("section"), x["bullet"].alias("bullet")))
    return F.filter(found, lambda x: x["section"].isNotNull())


def section_lines(posts: DataFrame, key: str = "id", text: str = "description") -> DataFrame:
    """key, pos, section and bullet of the lines that belong to a section."""
    # an outer explode works the array out once; an inner one would do so again to see whether it is empty
    return posts.select(key, F.inline_outer(sectioned(F.col(text)))).filter("pos is not null")


def extract(posts: DataFrame, key: str = "id", text: str = "description") -> DataFrame:
    """Adds required, preferred, responsibilities and technologies, arrays in the order of the text. Each posting by itself, so
    postings of one key stay what they are, and what is not read is not worked out."""
    none = F.array().cast("array<string>")
    of = lambda name: F.coalesce(F.transform(F.filter("_sectioned", lambda x: x["section"] == name), lambda x: x["bullet"]), none)
    phrases = F.slice(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\d+\+?\s*years?[^.\n]+"), F.lit(0)), 1, 5)
    d = posts.withColumn("_sectioned", sectioned(F.col(text)))
    d = d.withColumns({c: of(c) for c in ("required", "preferred", "responsibilities")}).drop("_sectioned")
    return d.withColumn("required", F.when(F.size("required") > 0, F.col("required")).otherwise(F.coalesce(phrases, none))).withColumn("technologies", technologies(F.col(text)))


def special_type(text: Column) -> Column:
    """Type that the wording gives a requirement, or null."""
    return (
        F.when(text.rlike(YEARS) | text.rlike("(?i)experience with"), "experience")
        .when(text.rlike("(?i)authorized to work|work authorization|eligible to work|visa"), "authorization")
        .when(text.rlike("(?i)security clearance|clearance required"), "clearance")
        .when(text.rlike(word("english|french|spanish|mandarin|bilingual")) & text.rlike("(?i)fluent|speak|language"), "language")
        .when(text.rlike("(?i)bachelor|master|phd|degree|diploma|education"), "education")
        .when(text.rlike("(?i)located in|must be in|on.?site in|based in|remote in"), "location")
    )


def special_hard(text: Column, kind: Column | None = None) -> Column:
    kind = special_type(text) if kind is None else kind
    must = text.rlike("(?i)must|required")
    return F.coalesce(
        F.when(kind == "experience", text.rlike("(?i)must|required|minimum")).when(kind.isin("authorization", "clearance"), F.lit(True)).when(kind.isin("language", "education", "location"), must),
        F.lit(False),
    )


def _requirement(kind: Column, text: Column, skill: Column, importance: str, hard: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"), skill.alias("skill"), F.lit(importance).alias("importance"), hard.alias("hard")).cast(REQUIREMENT)


def typed(text: Column, importance: str, default: str = "domain") -> Column:
    def one(x: Column) -> Column:
        """x: text, kind (or null) and tech, worked out once."""
        t, kind = x["text"], x["kind"]
        type_ = F.when(kind.isNull() & x["tech"].isNotNull(), "skill").when(t.rlike("(?i)years") & kind.isNull(), "experience").otherwise(F.coalesce(kind, F.lit(default)))
        hard = special_hard(t, kind) | (F.lit(importance == "required") & t.rlike("(?i)must|required|mandatory"))
        return _requirement(type_, t, x["tech"], importance, hard)

    known = F.array(F.struct(text.alias("text"), special_type(text).alias("kind"), F.get(technologies(text), 0).alias("tech")))
    return F.get(F.transform(known, one), 0)


def structured(posts: DataFrame) -> DataFrame:
    """Adds `requirements`: required, preferred and responsibility lines, technologies not named by them, experience,
    education, location and work authorization, in this order. posts: required, preferred, responsibilities,
    technologies, location, description and, if present, experience and education."""
    none = F.array().cast(f"array<{REQUIREMENT}>")
    lines = lambda c, importance, default="domain": F.coalesce(F.transform(c, lambda t: typed(t, importance, default)), none)
    one = lambda c, default: F.when(F.coalesce(c, F.lit("")) != "", F.array(typed(c, "required", default))).otherwise(none)
    given = lambda name: F.col(name) if name in posts.columns else F.lit(None).cast("string")
    # each step is a column of its own, so that no later one works it out again
    about = F.coalesce("description", F.lit(""))
    d = posts.withColumns({
        "_lines": F.concat(lines("required", "required"), lines("preferred", "preferred"), lines("responsibilities", "required", "responsibility")),
        "_techs": F.transform(F.coalesce("technologies", F.array().cast("array<string>")), lambda t: F.struct(t.alias("name"), canonical_skill(t).alias("skill"))),
        "_phrase": F.regexp_extract(about, r"(?i)(?:authorized to work|work authorization|eligible to work)[^.\n]{0,120}", 0),
        "_given": F.concat(one(given("experience"), "experience"), one(given("education"), "education")),
        "_place": F.when(F.coalesce("location", F.lit("")) != "", F.array(_requirement(F.lit("location"), F.col("location"), F.lit(None).cast("string"), "required", F.concat(F.col("location"), about).rlike(r"(?i)must be located|on.?site only")))).otherwise(none),
    })
    d = d.withColumn("_named", F.filter(F.transform("_lines", lambda r: r["skill"]), lambda x: x.isNotNull()))
    d = d.withColumn("_fresh", F.filter("_techs", lambda t: ~F.array_contains("_named", t["skill"])))
    # a technology that is there twice under one name gives one requirement, that of its first name
    first = F.filter("_fresh", lambda t, i: i == F.array_position(F.transform("_fresh", lambda x: x["skill"]), t["skill"]) - 1)
    techs = F.transform(first, lambda t: _requirement(F.lit("skill"), F.concat(F.lit("Experience with "), t["name"]), t["skill"], "required", F.lit(False)))
    d = d.withColumn("_all", F.concat("_lines", techs, "_given", "_place"))
    asks = (F.col("_phrase") != "") & ~F.exists("_all", lambda r: r["type"] == "authorization")
    right = F.array(_requirement(F.lit("authorization"), trim_blank(F.col("_phrase")), F.lit(None).cast("string"), "required", F.lit(True)))
    return d.withColumn("requirements", F.concat("_all", F.when(asks, right).otherwise(none))).drop("_lines", "_techs", "_phrase", "_given", "_place", "_named", "_fresh", "_all")


def skill_count(requirements: Column) -> Column:
    return F.size(F.filter(requirements, lambda r: (r["type"] == "skill") | (F.coalesce(r["skill"], F.lit("")) != "")))


def extraction_quality(requirements: Column) -> Column:
    """low, medium or high, by the numbers of requirements and of skills."""
    n, s = F.size(requirements), skill_count(requirements)
    return F.when((n < 3) | (s < 1), "low").when((n < 6) | (s < 2), "medium").otherwise("high")
