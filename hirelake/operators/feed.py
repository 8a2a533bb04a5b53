"""The posting feed: filters, keyset paging, latest analysis, order, page and cursor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROVIDERS = ["greenhouse", "lever", "ashby"]
DEFAULT_PAGE, MOST_PAGE = 50, 100


def latest(df: DataFrame, key: str, *newest: str, n: int = 1) -> DataFrame:
    """The n newest rows of each key; `newest` breaks ties in turn."""
    w = W.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in newest))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def latest_struct(df: DataFrame, key: str, columns: list[str], *newest: str) -> DataFrame:
    """One row per key with the newest row's columns as struct `latest`: one aggregation, no sort."""
    order = F.struct(*newest)
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("latest"))


def nested(df: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """The rows of each key as a sorted array of structs."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def conditions(remote_only: bool = False, since: Column | None = None, search: str | None = None, include_dismissed: bool = False, cursor: tuple | None = None) -> Column:
    """Filters that go to the scan. A null status is dropped with the dismissed ones; % and _ of a search act as wildcards."""
    tests = [] if include_dismissed else [F.col("status") != "dismissed"]
    if remote_only:
        tests.append(F.col("workplace") == "remote")
    if since is not None:
        tests.append(F.col("discovered") >= since)
    if search:
        pattern = f"%{search.strip()}%"
        tests.append(F.col("title").ilike(pattern) | F.col("location").ilike(pattern))
    if cursor:
        at, last = cursor
        tests.append((F.col("discovered") < at) | ((F.col("discovered") == at) & (F.col("id") < last)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def after_limit(min_score: float | None = None, classification: str | None = None, canada_only: bool = False, source: str | None = None, strong_unseen: bool = False) -> Column:
    """Filters that apply to what the limit has let through."""
    tests = []
    if strong_unseen:
        tests.append(~F.col("saved") & (F.col("status") != "dismissed") & F.coalesce(F.col("classification").isin("excellent", "strong"), F.lit(False)))
    if min_score:
        tests.append(F.coalesce("score", F.lit(0)) >= min_score)
    if classification:
        tests.append(F.col("classification") == classification)
    if canada_only:
        place = F.lower(F.coalesce("location", F.lit("")))
        tests.append(reduce(lambda a, b: a | b, (F.contains(place, F.lit(s)) for s in ("canada", "toronto", "vancouver", "montreal", "remote - canada"))))
    found = F.coalesce(F.col("provider").isin(PROVIDERS), F.lit(False))
    if source == "discovered":
        tests.append(found)
    elif source == "manual":
        tests.append(~found)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def newest_first(jobs: DataFrame, where: Column, limit: int) -> DataFrame:
    return jobs.filter(where).orderBy(F.col("discovered").desc(), F.col("id").desc()).limit(limit)


def order_page(df: DataFrame, sort: str = "recent") -> DataFrame:
    newest = [F.col("discovered").desc(), F.col("id").desc()]
    first = {"match": [F.coalesce("score", F.lit(0)).desc()], "salary": [F.coalesce("salary_max", F.lit(0)).desc()]}.get(sort, [])
    return df.orderBy(*first, *newest)


def feed(jobs: DataFrame, analyses: DataFrame, limit: int = DEFAULT_PAGE, sort: str = "recent", where: Column | None = None, post: Column | None = None) -> DataFrame:
    """A page of the feed, with one row more than `limit` never shown but told by `has_more`.
    Post filters and sorts work on the newest 3 * limit (200 at most), so that a page is the best of the newest."""
    limit = min(limit, MOST_PAGE)
    wide = sort in ("match", "salary") or post is not None
    page = newest_first(jobs, conditions() if where is None else where, min(3 * limit, 2 * MOST_PAGE) if wide else limit + 1)
    best = latest_struct(analyses, "job_id", ["score", "classification"], "created", "analysis_id")
    d = page.join(best, page["id"] == best["job_id"], "left").drop("job_id").select("*", "latest.*").drop("latest")
    d = d if post is None else d.filter(post)
    first = {"match": [F.coalesce("score", F.lit(0)).desc()], "salary": [F.coalesce("salary_max", F.lit(0)).desc()]}.get(sort, [])
    # a page is a few hundred rows at most, so one partition ranks it
    w = W.orderBy(*first, F.col("discovered").desc(), F.col("id").desc())
    d = d.withColumn("rank", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy()) > limit)
    return d.filter(F.col("rank") <= limit)


def score_history(analyses: DataFrame, n: int = 3) -> DataFrame:
    """The newest n analyses of each job, with the score of the newest less their own."""
    w = W.partitionBy("job_id").orderBy(F.col("created").desc(), F.col("analysis_id").desc())
    d = analyses.withColumn("rank", F.row_number().over(w)).withColumn("delta", F.first("score").over(w) - F.col("score"))
    return d.filter(F.col("rank") <= n)


def by_ids(owners: DataFrame, owner: str, ids: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of `table` that each owner's id array names, in the order of the array; unknown ids are dropped."""
    e = owners.select(owner, F.posexplode(ids).alias("pos", key)).join(table.select(key, value), key)
    return e.groupBy(owner).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("found"))


def either_key(left: DataFrame, right: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Look-up by key a, else by key b: two equi-joins, where a join on `or` would compare all pairs."""
    one = right.filter(F.col(a).isNotNull()).groupBy(a).agg(F.min(value).alias("_by_a"))
    two = right.filter(F.col(b).isNotNull()).groupBy(b).agg(F.min(value).alias("_by_b"))
    return left.join(one, a, "left").join(two, b, "left").withColumn("found", F.coalesce("_by_a", "_by_b")).drop("_by_a", "_by_b")
