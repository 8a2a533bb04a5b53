"""JSON files of postings and profiles as rows, and postings for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "struct<id:string,title:string,company:string,location:string,workplaceType:string,employmentType:string,description:string,salaryMin:int,salaryMax:int,salaryCurrency:string,requiredQualifications:array<string>,preferredQualifications:array<string>,responsibilities:array<string>,technologies:array<string>,source:string>"
PROFILE = "struct<yearsExperience:int,remotePreference:string,preferredLocations:array<string>,skills:array<struct<name:string>>,evidence:array<struct<sourceType:string,evidenceText:string,normalizedSkills:array<string>>>>"


def job_posts(files: DataFrame) -> DataFrame:
    """payload (JSON text of one posting) to the columns that requirements.structured takes."""
    none = F.array().cast("array<string>")
    d = files.select(F.from_json("payload", POST).alias("p")).select("p.*")
    lists = {"requiredQualifications": "required", "preferredQualifications": "preferred", "responsibilities": "responsibilities", "technologies": "technologies"}
    return d.select("id", "title", "company", "location", F.col("workplaceType").alias("workplace"), "description", *(F.coalesce(c, none).alias(name) for c, name in lists.items()))


def seed_profile(payload: Column) -> Column:
    """The profile struct that matching takes of a JSON text; evidence is named by its place."""
    p, none = F.from_json(payload, PROFILE), F.array().cast("array<string>")
    evidence = F.transform(p["evidence"], lambda e, i: F.struct(F.concat(F.lit("evidence-"), i.cast("string")).alias("id"), e["evidenceText"].alias("text"), F.coalesce(e["normalizedSkills"], none).alias("skills")))
    return F.struct(
        p["yearsExperience"].alias("years"),
        p["remotePreference"].alias("remote_preference"),
        F.coalesce(p["preferredLocations"], none).alias("preferred_locations"),
        F.coalesce(F.transform(p["skills"], lambda s: s["name"]), none).alias("skills"),
        F.coalesce(evidence, F.array().cast("array<struct<id:string,text:string,skills:array<string>>>")).alias("evidence"),
    )


def load_postings(spark: SparkSession, n: int, start: str) -> DataFrame:
    """n postings for load tests: even ones remote, odd ones hybrid in Toronto, one a minute back from `start`."""
    k, even = F.col("id"), F.col("id") % 2 == 0
    return spark.range(n).select(
        F.concat(F.lit("perf-"), k.cast("string")).alias("source_job_id"),
        F.concat(F.lit("Software Engineer "), k.cast("string")).alias("title"),
        F.when(even, "Remote").otherwise("Toronto, ON").alias("location"),
        F.when(even, "remote").otherwise("hybrid").alias("workplace"),
        (F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(mins=k.cast("int"))).alias("discovered"),
    )
