"""Board URLs, slugs, identity keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, trim_blank

# Address forms of the job boards.
LISTING = {"greenhouse": "https://boards.greenhouse.io/", "lever": "https://jobs.lever.co/", "ashby": "https://jobs.ashbyhq.com/"}
SINGLE_JOB = [r"(?i)greenhouse\.io/[^/]+/jobs/\d+", r"(?i)jobs\.lever\.co/[^/]+/[a-f0-9-]{8,}", r"(?i)jobs\.ashbyhq\.com/[^/]+/[a-f0-9-]{8,}"]
GREENHOUSE_API = r"(?i)boards-api\.greenhouse\.io/v1/boards/([^/?#]+)"
GREENHOUSE = r"(?i)(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)"
LEVER_JOB, LEVER = r"(?i)jobs\.lever\.co/([^/?#]+)/[a-f0-9-]+", r"(?i)jobs\.lever\.co/([^/?#]+)"
ASHBY_API = r"(?i)api\.ashbyhq\.com/posting-api/job-board/([^/?#]+)"
ASHBY_JOB, ASHBY = r"(?i)jobs\.ashbyhq\.com/([^/?#]+)/[a-f0-9-]+", r"(?i)jobs\.ashbyhq\.com/([^/?#]+)"


def is_single_job(url: Column) -> Column:
    t = trim_blank(url)
    return t.rlike(SINGLE_JOB[0]) | t.rlike(SINGLE_JOB[1]) | t.rlike(SINGLE_JOB[2])


def parse_board_url(url: Column) -> Column:
    """struct(provider, board_slug, board_url, is_single_job), null for other addresses."""
    t = F.regexp_replace(trim_blank(url), r"/+$", "")
    slug = lambda p: F.regexp_extract(t, p, 1)

    def board(provider: str, name: Column, address: Column, single) -> Column:
        return F.struct(F.lit(provider).alias("provider"), name.alias("board_slug"), address.alias("board_url"), F.lit(single).alias("is_single_job") if isinstance(single, bool) else single.alias("is_single_job"))

    listed = lambda provider, p: board(provider, slug(p), F.concat(F.lit(LISTING[provider]), slug(p)), False)
    job = t.rlike(r"(?i)/jobs/\d+")
    gh_url = F.when(job, t).otherwise(F.regexp_replace(t, r"(?i)/jobs/?$", ""))
    return (
        F.when(~t.rlike(r"(?i)^https?://"), F.lit(None))
        .when(t.rlike(GREENHOUSE_API), listed("greenhouse", GREENHOUSE_API))
        .when(t.rlike(GREENHOUSE), board("greenhouse", slug(GREENHOUSE), gh_url, job))
        .when(t.rlike(LEVER_JOB), board("lever", slug(LEVER_JOB), t, True))
        .when(t.rlike(LEVER), listed("lever", LEVER))
        .when(t.rlike(ASHBY_API), listed("ashby", ASHBY_API))
        .when(t.rlike(ASHBY_JOB), board("ashby", slug(ASHBY_JOB), t, True))
        .when(t.rlike(ASHBY), listed("ashby", ASHBY))
    )


def board_url_error(url: Column, provider: Column | None = None) -> Column:
    """What is wrong with a board address, or null: invalid, single_job or provider_mismatch."""
    parsed = parse_board_url(url)
    out = F.when(parsed.isNull(), F.lit("invalid")).when(parsed["is_single_job"], F.lit("single_job"))
    return out if provider is None else out.when(provider.isNotNull() & (parsed["provider"] != provider), F.lit("provider_mismatch"))


def board_url(provider: Column, slug: Column) -> Column:
    s = trim_blank(slug)
    return F.coalesce(*(F.when(provider == p, F.concat(F.lit(base), s)) for p, base in LISTING.items()))


def identity_key(provider: Column, slug: Column) -> Column:
    return F.concat(provider, F.lit(":"), F.lower(slug))


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 80)


def registry_id(provider: Column, slug: Column) -> Column:
    s = F.regexp_replace(F.lower(slug), r"[^a-z0-9-]", "-")
    return F.when(provider == "greenhouse", s).otherwise(F.concat(provider, F.lit("-"), s))


def name_from_slug(slug: Column) -> Column:
    parts = F.filter(F.split(slug, "[-_]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), " ")


def is_plausible_slug(slug: Column) -> Column:
    """2 to 80 characters of the slug alphabet, and not a number, a hash, a test board or one or two letters."""
    s = trim_blank(slug)
    junk = s.rlike(r"^\d+$") | s.rlike(r"(?i)^[a-f0-9]{8,}$") | s.rlike(r"(?i)test|demo|sandbox|example|intern") | s.rlike(r"^[a-z]{1,2}$")
    return F.length(s).between(2, 80) & ~junk & s.rlike(r"(?i)^[a-z0-9][a-z0-9._-]*$")


def truncate_location(col: Column) -> Column:
    return blank_to_null(F.substring(col, 1, 200))


def description_hash(col: Column) -> Column:
    return F.substring(F.sha2(trim_blank(col), 256), 1, 16)


def match_input_hash(description: Column, updated: Column, version: str) -> Column:
    stamp = F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(description, F.lit("none")), F.coalesce(stamp, F.lit("none")), F.lit(version)), 256), 1, 32)
