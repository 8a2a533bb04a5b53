"""Profiles from JSON that people and language models have written: what fits is taken, what doesn't is dropped and named.

A text is parsed once, as a VARIANT, and each field is then taken by the type it has: a field of another type than expected
counts as missing and leaves an error with its path, without any effect on the others. A skill is a text or an object with a
name; bullets and titles are lists or one text. A text that is no JSON object gives an empty profile and one error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import trim_blank

TEXTS = ("displayName", "location", "summary")
SKILL = "struct<name:string,category:string>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,bullets:array<string>>"


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is there and of a kind: STRING, OBJECT, ARRAY or VOID."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _missing(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    """The items of a list, or one text as a list; else none."""
    none = F.array().cast("array<variant>")
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_is(v, "STRING"), F.array(v)).otherwise(none)


def _wrong_text(v: Column, path: Column) -> Column:
    return F.when(~_missing(v) & ~_is(v, "STRING"), path)


def _wrong_list(v: Column, path: str, one: bool) -> Column:
    fits = _is(v, "ARRAY") | _is(v, "STRING") if one else _is(v, "ARRAY")
    return F.when(~_missing(v) & ~fits, F.lit(path))


def _at(path: str, i: Column, field: str = "") -> Column:
    return F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]" + (f".{field}" if field else "")))


def coerced(records: DataFrame, text: str = "text") -> DataFrame:
    """The columns of records with display_name, location, summary, skills, experiences, target_titles and errors (paths)."""
    v = F.try_parse_json(text)
    d = records.withColumn("_v", F.when(_is(v, "OBJECT"), v))
    fields = (*TEXTS, "skills", "experiences", "targetTitles")
    d = d.withColumns({f"_{f}": _field(F.col("_v"), f) for f in fields})
    items = {f: F.when(_is(F.col(f"_{f}"), "ARRAY") | F.lit(f == "targetTitles"), _list(F.col(f"_{f}"))).otherwise(F.array().cast("array<variant>")) for f in fields[3:]}
    d = d.withColumns({f"_{f}_items": c for f, c in items.items()})
    skill = lambda s: F.when(_is(s, "STRING"), F.struct(_text(s).alias("name"), F.lit(None).cast("string").alias("category"))).when(_is(s, "OBJECT"), F.struct(_text(_field(s, "name")).alias("name"), _text(_field(s, "category")).alias("category")))
    bullets = lambda e: F.filter(F.transform(_list(_field(e, "bullets")), _text), lambda b: b.isNotNull())
    experience = lambda e: F.when(_is(e, "OBJECT"), F.struct(F.coalesce(_text(_field(e, "company")), F.lit("")).alias("company"), F.coalesce(_text(_field(e, "title")), F.lit("")).alias("title"), _text(_field(e, "startDate")).alias("start"), _text(_field(e, "endDate")).alias("end"), bullets(e).alias("bullets")))
    skill_error = lambda s, i: F.when(_is(s, "OBJECT"), F.when(~_is(_field(s, "name"), "STRING"), _at("skills", i, "name"))).when(~_is(s, "STRING"), _at("skills", i))

    def experience_errors(e: Column, i: Column) -> Column:
        parts = [_wrong_text(_field(e, f), _at("experiences", i, f)) for f in ("company", "title", "startDate", "endDate")]
        b = _field(e, "bullets")
        parts.append(F.when(~_missing(b) & ~_is(b, "ARRAY") & ~_is(b, "STRING"), _at("experiences", i, "bullets")))
        parts.append(F.when(F.exists(_list(b), lambda x: ~_is(x, "STRING")), _at("experiences", i, "bullets[]")))
        return F.when(_is(e, "OBJECT"), F.array(*parts)).otherwise(F.array(_at("experiences", i)))

    errors = F.concat(
        F.array(F.when(F.col("_v").isNull(), "$"), *(_wrong_text(F.col(f"_{f}"), F.lit(f)) for f in TEXTS), _wrong_list(F.col("_skills"), "skills", False), _wrong_list(F.col("_experiences"), "experiences", False), _wrong_list(F.col("_targetTitles"), "targetTitles", True)),
        F.transform("_skills_items", skill_error),
        F.flatten(F.transform("_experiences_items", experience_errors)),
        F.transform("_targetTitles_items", lambda t, i: F.when(~_is(t, "STRING"), _at("targetTitles", i))),
    )
    there = lambda x: x.isNotNull()
    named = F.filter(F.transform("_skills_items", skill), lambda s: F.coalesce(s["name"], F.lit(None).cast("string")).isNotNull())
    return d.select(
        *records.columns,
        *(_text(F.col(f"_{f}")).alias(name) for f, name in zip(TEXTS, ("display_name", "location", "summary"), strict=True)),
        named.alias("skills"),
        F.filter(F.transform("_experiences_items", experience), there).alias("experiences"),
        F.filter(F.transform("_targetTitles_items", _text), there).alias("target_titles"),
        F.filter(errors, there).alias("errors"),
    )


def sanitised(profiles: DataFrame) -> DataFrame:
    """coerced() without what is blank: skills without a name, experiences without company and title, blank bullets and titles."""
    full = lambda x: trim_blank(x) != ""
    trimmed = lambda e: F.struct(trim_blank(e["company"]).alias("company"), trim_blank(e["title"]).alias("title"), e["start"].alias("start"), e["end"].alias("end"), F.filter(F.transform(e["bullets"], trim_blank), lambda b: b != "").alias("bullets"))
    return profiles.withColumns({
        "skills": F.filter("skills", lambda s: full(s["name"])),
        "experiences": F.filter(F.transform("experiences", trimmed), lambda e: (e["company"] != "") | (e["title"] != "")),
        "target_titles": F.filter("target_titles", full),
    })


def as_resume(profiles: DataFrame) -> DataFrame:
    """A sanitised profile in the form of a parsed resume: id, full_name, location, summary, skill_groups, experience (with current:
    its end says present) and warnings."""
    group = F.array(F.struct(F.lit(None).cast("string").alias("category"), F.transform("skills", lambda s: s["name"]).alias("skills")))
    none = F.array().cast("array<string>")
    entry = lambda e: F.struct(e["company"].alias("company"), e["title"].alias("title"), e["start"].alias("start"), e["end"].alias("end"), F.lit(None).cast("string").alias("location"), e["bullets"].alias("achievements"), none.alias("technologies"), F.coalesce(F.rlike(e["end"], F.lit("(?i)present")), F.lit(False)).alias("current"))
    groups = F.when(F.size("skills") > 0, group).otherwise(F.array().cast("array<struct<category:string,skills:array<string>>>"))
    return profiles.select("id", F.col("display_name").alias("full_name"), "location", "summary", groups.alias("skill_groups"), F.transform("experiences", entry).alias("experience"), F.array(F.lit("legacy_import")).alias("warnings"))
