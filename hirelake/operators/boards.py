"""Board payloads to postings of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import clean_title, html_to_text, trim_blank
from hirelake.functions.urls import truncate_location
from hirelake.operators import requirements

GREENHOUSE = "struct<jobs:array<struct<id:bigint,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string>>,companyName:string,board:string>"
LEVER = "array<struct<id:string,text:string,hostedUrl:string,categories:struct<location:string,team:string,commitment:string>,createdAt:bigint>>"
ASHBY = "struct<jobs:array<struct<id:string,title:string,employmentType:string,location:string,publishedAt:string,isRemote:boolean,workplaceType:string,jobUrl:string,descriptionHtml:string>>,companyName:string,board:string>"
POSTING = ["provider", "company", "title", "location", "workplace", "job_url", "source_job_id", "date_posted", "employment_type", "description"]


def board_name(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "[-_]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), " ")


def _remote(location: Column) -> Column:
    return F.when(F.coalesce(location, F.lit("")).rlike("(?i)remote"), "remote").otherwise("unknown")


def workplace_type(is_remote: Column, workplace: Column, location: Column) -> Column:
    w = F.lower(F.coalesce(workplace, F.lit("")))
    return (
        F.when(F.coalesce(is_remote, F.lit(False)) | (w == "remote"), "remote")
        .when(w == "hybrid", "hybrid")
        .when(w.isin("onsite", "on_site", "on-site"), "on_site")
        .otherwise(_remote(location))
    )


def _company(p: str) -> Column:
    return F.coalesce(f"{p}.companyName", board_name(F.col(f"{p}.board")), F.lit("Company"))


def _greenhouse(raw: DataFrame) -> DataFrame:
    d = raw.select(F.from_json("payload", GREENHOUSE).alias("p")).select(_company("p").alias("company"), F.explode("p.jobs").alias("j"))
    return d.select(F.lit("greenhouse").alias("provider"), "company", clean_title(F.col("j.title")).alias("title"), truncate_location(F.col("j.location.name")).alias("location"), _remote(F.col("j.location.name")).alias("workplace"), F.col("j.absolute_url").alias("job_url"), F.col("j.id").cast("string").alias("source_job_id"), F.col("j.updated_at").alias("date_posted"), F.lit(None).cast("string").alias("employment_type"), html_to_text(F.col("j.content")).alias("description"))


def _lever(raw: DataFrame) -> DataFrame:
    slug = F.nullif(F.regexp_extract("url", r"(?i)jobs\.lever\.co/([^/]+)", 1), F.lit(""))
    d = raw.select(F.coalesce(board_name(slug), F.lit("Company")).alias("board"), F.explode(F.from_json("payload", LEVER)).alias("j")).withColumn("text", html_to_text(F.col("j.text")))
    line = F.get(F.filter(F.transform(F.split("text", "\n"), trim_blank), lambda x: x != ""), 0)
    team = clean_title(F.col("j.categories.team"), "")
    posted = F.date_format(F.timestamp_millis("j.createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return d.select(F.lit("lever").alias("provider"), F.when(F.coalesce(team, F.lit("")) != "", team).otherwise(F.col("board")).alias("company"), clean_title(line).alias("title"), truncate_location(F.col("j.categories.location")).alias("location"), _remote(F.col("j.categories.location")).alias("workplace"), F.col("j.hostedUrl").alias("job_url"), F.col("j.id").alias("source_job_id"), posted.alias("date_posted"), F.col("j.categories.commitment").alias("employment_type"), F.col("text").alias("description"))


def _ashby(raw: DataFrame) -> DataFrame:
    d = raw.select(F.from_json("payload", ASHBY).alias("p")).select(_company("p").alias("company"), F.explode("p.jobs").alias("j"))
    text = html_to_text(F.coalesce("j.descriptionHtml", F.lit("")))
    return d.select(F.lit("ashby").alias("provider"), "company", clean_title(F.col("j.title")).alias("title"), truncate_location(F.col("j.location")).alias("location"), workplace_type(F.col("j.isRemote"), F.col("j.workplaceType"), F.col("j.location")).alias("workplace"), F.col("j.jobUrl").alias("job_url"), F.col("j.id").alias("source_job_id"), F.col("j.publishedAt").alias("date_posted"), F.col("j.employmentType").alias("employment_type"), F.coalesce(F.nullif(text, F.lit("")), "j.title").alias("description"))


NORMALIZERS = {"greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby}


def normalize(raw: DataFrame) -> DataFrame:
    """raw: provider, url and payload (JSON text), one row per board. Rows of other providers give nothing."""
    parts = [f(raw.filter(F.col("provider") == p)) for p, f in NORMALIZERS.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def postings(raw: DataFrame) -> DataFrame:
    """normalize(), with id and the sections and technologies of the text."""
    d = normalize(raw).withColumn("id", F.sha2(F.concat_ws("|", "provider", "source_job_id"), 256))
    return requirements.extract(d)
