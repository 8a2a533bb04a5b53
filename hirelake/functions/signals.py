"""What a posting says about place, remote work and field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import any_of, word

# Word patterns of the signals. The two lists of Canadian places are kept apart on purpose.
CANADA = ["canada", r"remote\s*[-–—]?\s*canada", r"canada\s*remote", r"remote\s+canada", "ontario", "toronto", "vancouver", "british columbia", "alberta", "calgary", "montreal", "montréal", "quebec", "québec", "ottawa", "waterloo", "kitchener", "hamilton"]
REMOTE_CANADA = [r"remote\s*[-–—]?\s*canada", r"canada\s*remote", r"remote\s+canada", r"canada\s*only", r"remote\s+in\s+canada"]
REMOTE = ["remote", "work from anywhere", "anywhere in the world", "globally remote"]
FRONTEND_TITLE = ["frontend engineer", r"front[\s-]?end engineer", "frontend developer", r"front[\s-]?end developer", "ui engineer", "web engineer", r"software engineer[,\s-]+frontend", r"software engineer\s*-\s*frontend", "product engineer"]
FRONTEND_WORD = ["frontend|front-end|front end|ui engineer|web engineer"]
REACT, TYPESCRIPT = ["react", r"react\.js", r"next\.js"], ["typescript", "ts"]
US_ONLY, REGIONS = ["us only|united states only|us-based"], ["europe|emea|apac|uk only|latam"]
BLOCKED_TITLE = [r"sales|account executive|business development|recruiter|talent acquisition", "customer success|support specialist|call center", "data scientist|machine learning engineer|research scientist", "intern|internship|co-op|new grad only", "warehouse|driver|nurse|physician|attorney|paralegal"]
BLOCKED_PREFIX = r"(?i)(?<![A-Za-z0-9_])internship"
ALLOWED_TITLE = ["frontend|front-end|front end", r"full[\s-]?stack|software|web|product|platform|mobile|ios|android", "engineer|developer|programmer|architect", "ui|ux|design engineer", "react|typescript|javascript|node"]
IMPORT_CANADA = ["canada", "toronto", "vancouver", "montreal", "ottawa", "calgary"]
FEED_CANADA = ["canada", "toronto", "vancouver", "montreal", "remote - canada"]


def says(col: Column, patterns: list[str]) -> Column:
    return any_of(col, [word(p, "iu") for p in patterns])


def _place(location: Column, description: Column, n: int) -> Column:
    return F.concat(F.coalesce(location, F.lit("")), F.lit(" "), F.substring(description, 1, n))


def location_class(location: Column, description: Column, workplace: Column) -> Column:
    """remote-canada, remote-us, remote-region-specific, remote-unknown, hybrid, onsite (in Canada) or unknown."""
    place = _place(location, description, 800)
    canada = says(place, CANADA)
    remote = F.coalesce(workplace == "remote", F.lit(False)) | says(place, REMOTE)
    return (
        F.when(says(place, REMOTE_CANADA), "remote-canada")
        .when(remote & says(place, US_ONLY), "remote-us")
        .when(remote & canada, "remote-canada")
        .when(remote & says(place, REGIONS), "remote-region-specific")
        .when(remote, "remote-unknown")
        .when(workplace == "hybrid", "hybrid")
        .when(canada, "onsite")
        .otherwise("unknown")
    )


def job_text(title: Column, description: Column, techs: Column) -> Column:
    return F.concat(title, F.lit(" "), description, F.lit(" "), F.coalesce(F.array_join(techs, " "), F.lit("")))


def is_frontend(title: Column, text: Column) -> Column:
    return says(title, FRONTEND_TITLE) | (says(title, FRONTEND_WORD) & (says(text, REACT) | says(text, TYPESCRIPT)))


def is_canada(location: Column, description: Column) -> Column:
    return says(_place(location, description, 500), CANADA)


def title_fits(title: Column, targets: Column) -> Column:
    """No blocked word; then one of the target titles if there are any, else one of the allowed words."""
    low = F.lower(title)
    wanted = F.exists(targets, lambda t: F.contains(low, F.lower(t)))
    return ~(says(low, BLOCKED_TITLE) | low.rlike(BLOCKED_PREFIX)) & F.when(F.size(F.coalesce(targets, F.array().cast("array<string>"))) > 0, wanted).otherwise(says(low, ALLOWED_TITLE))


def location_fits(location: Column, description: Column, workplace: Column, preferred: Column) -> Column:
    place = F.lower(_place(location, description, 500))
    remote = F.coalesce(workplace == "remote", F.lit(False)) | says(place, ["remote"])
    return remote | says(place, IMPORT_CANADA) | F.coalesce(F.exists(preferred, lambda p: F.contains(place, F.lower(p))), F.lit(False))


def import_reason(title: Column, location: Column, description: Column, workplace: Column, targets: Column, preferred: Column) -> Column:
    """Why a posting is left out: title_mismatch or location_mismatch; null if it is taken."""
    return F.when(~title_fits(title, targets), "title_mismatch").when(~location_fits(location, description, workplace, preferred), "location_mismatch")
