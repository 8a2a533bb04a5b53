"""The registry of company boards: candidates, merge, audit, ids, catalog filters and suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import trim_blank
from hirelake.functions.urls import board_url, identity_key, is_plausible_slug, name_from_slug, registry_id, slugify
from hirelake.sources.shared import stored
from hirelake.sources.versions import Versions

LEGACY_TAGS = ["remote-canada", "frontend-heavy", "remote-friendly"]


def first_per_key(df: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Plausible candidates, the first of each board. candidates: provider, slug and pos (their order)."""
    d = candidates.filter(is_plausible_slug(F.col("slug"))).withColumn("key", identity_key(F.col("provider"), F.col("slug")))
    return first_per_key(d, "key", "pos")


def dedupe_by_board(entries: DataFrame) -> DataFrame:
    """One entry per board: the first, but a verified one before others."""
    d = entries.withColumn("key", identity_key(F.col("provider"), F.col("slug")))
    return first_per_key(d, "key", (F.col("status") == "verified").desc(), F.col("pos"))


def without_legacy(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t.isin(LEGACY_TAGS))


def merge_entries(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Registry after candidates are merged in: what a candidate states wins, what it leaves out stays.
    existing: id, name, provider, slug, url, country, industries, status; candidates: provider, slug, pos and,
    nullable, name, url, country, industries."""
    e = existing.withColumn("key", identity_key(F.col("provider"), F.col("slug"))).alias("e")
    c = dedupe_candidates(candidates).alias("c")
    d = e.join(c, F.col("e.key") == F.col("c.key"), "full")
    new = F.col("c.key").isNotNull()
    slug, provider = trim_blank(F.col("c.slug")), F.col("c.provider")
    pick = lambda name: F.when(new, F.coalesce(F.col(f"c.{name}"), F.col(f"e.{name}"))).otherwise(F.col(f"e.{name}"))
    name = F.when(new, F.coalesce(F.nullif(trim_blank(F.col("c.name")), F.lit("")), F.nullif("e.name", F.lit("")), name_from_slug(slug))).otherwise(F.col("e.name"))
    none = F.array().cast("array<string>")
    return d.select(
        F.coalesce("e.id", registry_id(provider, slug)).alias("id"),
        name.alias("name"),
        slugify(name).alias("name_slug"),
        F.coalesce(provider, "e.provider").alias("provider"),
        F.coalesce(slug, "e.slug").alias("slug"),
        F.when(new, F.coalesce("c.url", board_url(provider, slug))).otherwise(F.col("e.url")).alias("url"),
        pick("country").alias("country"),
        F.when(new, without_legacy(F.coalesce("c.industries", "e.industries", none))).otherwise(F.col("e.industries")).alias("industries"),
        F.coalesce("e.status", F.lit("verification_failed")).alias("status"),
    )


#: What a candidate states about a board wins; the rest is what verification has found out, and stays.
STATED = {"website": "string", "careers_url": "string", "country": "string", "discovery_source": "string"}
KEPT = {"countries": "array<string>", "enabled": "boolean", "status": "string", "verified_at": "string", "last_job_count": "long", "verification_error": "string", "signals": "map<string,boolean>", "last_synced_at": "string"}
ENTRY = "id string, name string, name_slug string, provider string, slug string, url string, industries array<string>, " + ", ".join(f"{k} {t}" for k, t in (STATED | KEPT).items())
CANDIDATE = "provider string, slug string, pos long, name string, url string, industries array<string>, " + ", ".join(f"{k} {t}" for k, t in STATED.items())


def board_key(provider: str = "provider", slug: str = "slug") -> Column:
    return identity_key(F.col(provider), F.col(slug))


def merge_all(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The entries (ENTRY) after candidates (CANDIDATE, all but provider, slug and pos nullable) are merged in, field by field.
    New entries are enabled and unverified. Of candidates of one board the first counts; entries have a board once."""
    e, c = entries.withColumn("_key", board_key()).alias("e"), dedupe_candidates(candidates).alias("c")
    d = e.join(c, F.col("e._key") == F.col("c.key"), "full")
    new, slug, provider = F.col("c.key").isNotNull(), trim_blank(F.col("c.slug")), F.col("c.provider")
    name = F.coalesce(F.nullif(trim_blank(F.col("c.name")), F.lit("")), F.nullif("e.name", F.lit("")), name_from_slug(slug))
    none = F.array().cast("array<string>")
    merged = {
        "id": F.coalesce("e.id", registry_id(provider, slug)),
        "name": F.when(new, name).otherwise(F.col("e.name")),
        "name_slug": F.when(new, slugify(name)).otherwise(F.col("e.name_slug")),
        "provider": F.coalesce(provider, "e.provider"),
        "slug": F.coalesce(slug, "e.slug"),
        "url": F.when(new, F.coalesce("c.url", board_url(provider, slug))).otherwise(F.col("e.url")),
        "industries": F.when(new, without_legacy(F.coalesce("c.industries", "e.industries", none))).otherwise(F.col("e.industries")),
        **{k: F.coalesce(f"c.{k}", f"e.{k}") for k in STATED},
        **{k: F.col(f"e.{k}") for k in KEPT},
    }
    unset = {"enabled": F.lit(True), "status": F.lit("verification_failed")}
    merged |= {k: F.when(new, F.coalesce(f"e.{k}", v)).otherwise(F.col(f"e.{k}")) for k, v in unset.items()}
    return d.select(*(c.alias(k) for k, c in merged.items()))


def upsert(store: Versions, candidates: DataFrame, table: str = "registry", attempts: int = 20) -> int:
    """Merges candidates into the stored registry and gives the new version. Only the ranges of the candidates' boards are read
    and written; where another writer has changed one of them meanwhile, the merge is made anew from its version."""
    key = board_key()
    found = dedupe_candidates(candidates).select(*candidates.columns)
    ranges = store.ranges_of(found, key)
    if not ranges:
        return store.latest()
    return store.change(lambda base: [store.write(table, merge_all(store.read(table, base, ranges, ENTRY), found), key, ranges)], attempts)


RESULT = "provider string, slug string, name string, url string, status string, job_count long, error string, signals map<string,boolean>, at string"


def written_back(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries with what a verification (RESULT) has found about their boards: a board is enabled if it is verified, and only
    then has a new time of verification; name and signals stay where none are found."""
    r = results.select(board_key().alias("_key"), *(F.col(x.split(" ")[0]).alias(f"_{x.split(' ')[0]}") for x in RESULT.split(", ")[2:]))
    d = entries.withColumn("_key", board_key()).join(r, "_key", "left")
    done, ok = F.col("_status").isNotNull(), F.col("_status") == "verified"
    found = {"status": F.col("_status"), "verified_at": F.when(ok, F.col("_at")).otherwise(F.col("verified_at")), "last_job_count": F.col("_job_count"), "verification_error": F.col("_error"), "last_synced_at": F.col("_at"), "enabled": ok, "url": F.col("_url")}
    d = d.withColumns({k: F.when(done, v).otherwise(F.col(k)) for k, v in found.items()})
    d = d.withColumns({"name": F.coalesce("_name", "name"), "signals": F.coalesce("_signals", "signals")})
    return d.select(*entries.columns)


def write_back(store: Versions, results: DataFrame, table: str = "registry", attempts: int = 20) -> int:
    """Publishes the registry with the results of a verification, one row a board."""
    key = board_key()
    ranges = store.ranges_of(results, key)
    return store.change(lambda base: [store.write(table, written_back(store.read(table, base, ranges, ENTRY), results), key, ranges)], attempts)


def duplicate_keys(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys that more than one row has, with their members: for a report on tables of boards, whose keys have few."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(member)).alias("members")).filter("n > 1")


def duplicate_rows(df: DataFrame, key: Column) -> DataFrame:
    """The rows whose key others have too, with key and n, their number. Keys and rows are written first, each worked out
    once; the numbers too, because rows of a hot key can be split in a join only if its other side is not an
    aggregate of the same exchange."""
    spark = df.sparkSession
    d = stored(spark, df.withColumn("key", key), "keyed")
    many = stored(spark, d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "numbers")
    return d.join(many, "key")


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def unique_ids(entries: DataFrame) -> DataFrame:
    """Where an id is there more than once, all but the greenhouse entries get the id of their board."""
    same = F.count(F.lit(1)).over(W.partitionBy("id"))
    return entries.withColumn("id", F.when((same > 1) & (F.col("provider") != "greenhouse"), registry_id(F.col("provider"), F.col("slug"))).otherwise(F.col("id")))


def suffixed_ids(entries: DataFrame) -> DataFrame:
    """Ids after the first of their kind get the provider as suffix."""
    again = F.row_number().over(W.partitionBy("id").orderBy("pos")) > 1
    return entries.withColumn("id", F.when(again, F.concat_ws("-", "id", "provider")).otherwise(F.col("id")))


def filter_catalog(entries: DataFrame, provider: str | None = None, country: str | None = None, industry: str | None = None, signal: str | None = None, search: str | None = None) -> DataFrame:
    tests = []
    if provider:
        tests.append(F.col("provider") == provider)
    if country:
        tests.append(F.col("country") == country)
    if industry:
        tests.append(F.array_contains("industries", industry))
    if signal:
        tests.append(F.coalesce(F.col(f"signals.{signal}"), F.lit(False)))
    if search:
        tests.append(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(search.lower())) for c in ("name", "id", "slug"))))
    return entries.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def suggest(scored: DataFrame, points: list[tuple[Column, int]], followed: DataFrame | None, url: str, name: str, n: int = 8) -> DataFrame:
    """The n entries with most points (above 0) that are not followed yet; ties by name."""
    d = scored if followed is None else scored.join(followed, url, "left_anti")
    total = reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in points))
    return d.withColumn("points", total).filter("points > 0").orderBy(F.col("points").desc(), F.col(name)).limit(n)


def by_name(entries: DataFrame) -> DataFrame:
    """Entries in the order of their names as people sort them: case and accents count last."""
    return entries.orderBy(F.collate("name", "UNICODE_CI_AI"), F.collate("name", "UNICODE"), "id")


def verified_catalog(entries: DataFrame) -> DataFrame:
    """The catalog of what is enabled and verified, in the order of names, one JSON object a row."""
    kept = entries.filter(F.col("enabled") & (F.col("status") == "verified"))
    return by_name(kept).select("id", F.to_json(F.struct(*entries.columns)).alias("entry"))


def payload_bytes(*columns: str) -> Column:
    """Bytes of a row's JSON."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
