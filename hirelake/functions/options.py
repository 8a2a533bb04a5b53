"""Free text of a profile to one of its options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options, and the words that stand for them, in the order in which they are looked for.
WORK = (["canadian_citizen", "permanent_resident", "open_work_permit", "employer_sponsored", "us_authorized", "requires_sponsorship"], [("citizen", "canadian_citizen"), ("permanent resident", "permanent_resident"), ("open work", "open_work_permit"), ("sponsor", "requires_sponsorship"), ("us.*authorized|authorized.*us", "us_authorized")])
SENIORITY = (["junior", "mid", "senior", "lead", "staff"], [("staff|principal", "staff"), ("senior", "senior"), ("lead", "lead"), ("mid", "mid"), ("junior", "junior")])
REMOTE = (["remote", "hybrid", "on_site", "flexible"], [("remote", "remote"), ("hybrid", "hybrid"), ("on-site|onsite", "on_site")])


def option(value: Column, table: tuple[list[str], list[tuple[str, str]]]) -> Column:
    """The option itself, else the first whose words the text has, else an empty text."""
    options, rules = table
    out = F.when(value.isin(options), value)
    for pattern, name in rules:
        out = out.when(F.lower(value).rlike(f"(?s){pattern}"), name)
    return F.coalesce(out, F.lit(""))


def work_authorization(value: Column) -> Column:
    return option(value, WORK)


def seniority(value: Column) -> Column:
    return option(value, SENIORITY)


def remote_preference(value: Column) -> Column:
    return option(value, REMOTE)


def humanize(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def score_label(score: Column) -> Column:
    return F.coalesce(F.concat(F.floor(score + 0.5).cast("string"), F.lit("%")), F.lit("—"))
