"""Month tokens and date ranges as resumes write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import trim_blank

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month_token(col: Column) -> Column:
    """YYYY-MM of "Jun 2022", "6/2022" or "2022" (January); null for anything else."""
    t = F.lower(trim_blank(col))
    name, year = F.regexp_extract(t, r"^([a-z]{3})[a-z]*\.?\s+(\d{4})\z", 1), F.regexp_extract(t, r"(\d{4})\z", 1)
    table = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")))
    number = F.regexp_extract(t, r"^(\d{1,2})/\d{4}\z", 1)
    return (
        F.when((name != "") & F.try_element_at(table, name).isNotNull(), F.concat_ws("-", year, F.try_element_at(table, name)))
        .when(number != "", F.concat_ws("-", year, F.lpad(number, 2, "0")))
        .when(t.rlike(r"^\d{4}\z"), F.concat(t, F.lit("-01")))
    )


def date_range(col: Column) -> Column:
    """struct(start, end, current) of a range with a dash; an open end is current."""
    parts = F.split(trim_blank(col), r"\s*[-–—]\s*|\s+to\s+")
    last = F.lower(F.get(parts, 1))
    current = F.coalesce(last.rlike("present|current|now"), F.lit(False))
    return F.struct(month_token(F.get(parts, 0)).alias("start"), F.when(~current, month_token(F.get(parts, 1))).alias("end"), current.alias("current"))


def int_or_null(col: Column) -> Column:
    """The number in a text, cut toward zero; null where there is none."""
    d = trim_blank(col).try_cast("double")
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("long")


def month_key(col: Column) -> Column:
    """The part of a month's name that names it: its first three letters, but sept."""
    t = F.replace(F.lower(col), F.lit("."), F.lit(""))
    return F.when(t.startswith("sept"), "sept").otherwise(F.substring(t, 1, 3))


def is_new(discovered: Column, now: Column) -> Column:
    """Found less than a day ago."""
    return F.coalesce(discovered > now - F.make_dt_interval(days=F.lit(1)), F.lit(False))
