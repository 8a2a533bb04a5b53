"""Approving parsed resumes: the profile and the state of its resume change in one version, for many users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.profile import profile_rows
from hirelake.sources.shared import stored
from hirelake.sources.versions import Change, Versions

PARSED = "version_id string, user_id string, profile_id string, status string, approved_at string"


def checked(parsed: DataFrame, approvals: DataFrame) -> DataFrame:
    """approvals (version_id, user_id and the edited resume) with profile_id and error: not_found (also another user's),
    still_parsing, or null. A version is approved once, however often it is asked for."""
    p = parsed.select("version_id", F.col("user_id").alias("_owner"), "profile_id", F.col("status").alias("_status"))
    d = approvals.dropDuplicates(["version_id", "user_id"]).join(p, "version_id", "left")
    error = F.when(F.coalesce(F.col("_owner") != F.col("user_id"), F.lit(True)), "not_found").when(F.col("_status") == "processing", "still_parsing")
    return d.withColumn("error", error).drop("_owner", "_status")


def _parsed_tables(store: Versions, approvals: DataFrame, at: str, base: int) -> list[Change]:
    version, profile = F.col("version_id"), F.col("profile_id")
    ranges = store.ranges_of(approvals, version)
    parsed = store.read("parsed_versions", base, ranges, PARSED)
    good = stored(parsed.sparkSession, checked(parsed, approvals).filter("error IS NULL"), "approved")
    now = parsed.join(good.select("version_id", F.lit(True).alias("_now")), "version_id", "left")
    now = now.withColumns({"status": F.when(F.col("_now"), "approved").otherwise(F.col("status")), "approved_at": F.when(F.col("_now"), at).otherwise(F.col("approved_at"))})
    changes = [store.write("parsed_versions", now.select(*parsed.columns), version, ranges)]
    of_profile = store.ranges_of(good, profile)
    for name, rows in profile_rows(good).items():
        # what the profile had goes, whatever it came from; others in its ranges stay
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        kept = store.read(name, base, of_profile, schema).join(good.select("profile_id"), "profile_id", "left_anti").select(*rows.columns)
        changes.append(store.write(name, kept.unionByName(rows), profile, of_profile))
    return changes


def approve(store: Versions, approvals: DataFrame, at: str, attempts: int = 20) -> int:
    """Publishes the version in which all approvals that hold are made: states, skills, experiences, bullets, projects and
    evidence. approvals: version_id, user_id, skill_groups, experience and projects, as for profile.profile_rows."""
    return store.change(lambda base: _parsed_tables(store, approvals, at, base), attempts)
