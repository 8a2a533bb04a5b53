"""Queries on postings, their requirements and their match with a profile, and SQL that computes the same by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import signals, skills
from hirelake.operators import matching, requirements
from hirelake.plans.catalog import query
from hirelake.plans.derived import POSTS_SQL, PROFILES_SQL, posts, quoted, with_profile

_SYNONYMS = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in skills.CANONICAL.items()) + "}"


def _canon(x: str) -> str:
    return f"coalesce({_SYNONYMS}[lower(trim({x}))], lower(trim({x})))"


def _techs(x: str) -> str:
    found = f"list_transform(list_filter({quoted(skills.TECH_KEYWORDS)}, lambda k: contains(lower({x}), k)), lambda k: {_canon('k')})"
    return f"list_filter({found}, lambda t, i: list_position({found}, t) = i)"


# lines under the last heading above them
_SECTIONS = rf"""post AS ({POSTS_SQL}),
raw AS (SELECT id, unnest(string_split(description, chr(10))) AS line, unnest(range(len(string_split(description, chr(10))))) AS pos FROM post),
line AS (SELECT id, pos, trim(line) AS line FROM raw WHERE trim(line) <> ''),
head AS (SELECT *, CASE WHEN length(line) > 80 THEN NULL
    WHEN regexp_full_match(line, '(?i)(required|must have|minimum qualifications|qualifications|what you.?ll need|you have:?)') OR (length(line) < 60 AND regexp_matches(line, '(?i)required|must have|minimum qualifications|you have')) THEN 'required'
    WHEN regexp_full_match(line, '(?i)(preferred|nice to have|nice-to-have|bonus|plus:?)') OR (length(line) < 60 AND regexp_matches(line, '(?i)preferred|nice to have|bonus')) THEN 'preferred'
    WHEN regexp_full_match(line, '(?i)(responsibilities|what you.?ll do|you.?ll do|what we.?re looking for you to do|your role)') OR (length(line) < 60 AND regexp_matches(line, '(?i)responsibilit')) THEN 'responsibilities' END AS head FROM line),
carried AS (SELECT id, pos, head, trim(regexp_replace(line, '^[-•*]\s*', '')) AS bullet, last_value(head IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM head),
bullets AS (SELECT id, pos, coalesce(section, CASE WHEN regexp_matches(bullet, '(?i)^[0-9]+\+?\s*years?') OR regexp_matches(bullet, '(?i)experience with') THEN 'required' END) AS section, bullet FROM carried WHERE head IS NULL AND length(bullet) >= 10)"""


@query(f"WITH {_SECTIONS} SELECT id, pos, section, bullet FROM bullets WHERE section IS NOT NULL")
def section_carry(spark, sf_dir):
    return requirements.section_lines(posts(spark, sf_dir)).select("id", "pos", "section", "bullet")


_KIND = r"""CASE WHEN regexp_matches(text, '(?i)[0-9]+\+?\s*years?') OR regexp_matches(text, '(?i)experience with') THEN 'experience'
    WHEN regexp_matches(text, '(?i)authorized to work|work authorization|eligible to work|visa') THEN 'authorization'
    WHEN regexp_matches(text, '(?i)security clearance|clearance required') THEN 'clearance'
    WHEN regexp_matches(text, '(?i)\b(english|french|spanish|mandarin|bilingual)\b') AND regexp_matches(text, '(?i)fluent|speak|language') THEN 'language'
    WHEN regexp_matches(text, '(?i)bachelor|master|phd|degree|diploma|education') THEN 'education'
    WHEN regexp_matches(text, '(?i)located in|must be in|on.?site in|based in|remote in') THEN 'location' END"""

# (block, pos) is the order of a posting's requirements
_REQUIREMENTS = rf"""{_SECTIONS},
first AS (SELECT p.id, 1 AS block, b.pos, b.bullet AS text, 'required' AS importance, 'domain' AS otherwise FROM post p JOIN bullets b USING (id) WHERE b.section = 'required'),
phrase AS (SELECT id, unnest(regexp_extract_all(description, '(?i)[0-9]+\+?\s*years?[^.\n]+')[1:5]) AS text, unnest(range(len(regexp_extract_all(description, '(?i)[0-9]+\+?\s*years?[^.\n]+')[1:5]))) AS pos FROM post WHERE id NOT IN (SELECT id FROM first)),
texts AS (SELECT * FROM first UNION ALL SELECT id, 1, pos, text, 'required', 'domain' FROM phrase
    UNION ALL SELECT id, 2, pos, bullet, 'preferred', 'domain' FROM bullets WHERE section = 'preferred'
    UNION ALL SELECT id, 3, pos, bullet, 'required', 'responsibility' FROM bullets WHERE section = 'responsibilities'),
known AS (SELECT *, {_KIND} AS kind, {_techs("text")} AS techs FROM texts),
typed AS (SELECT id, block, pos, CASE WHEN kind IS NULL AND len(techs) > 0 THEN 'skill' WHEN kind IS NULL AND regexp_matches(text, '(?i)years') THEN 'experience' ELSE coalesce(kind, otherwise) END AS type, text, techs[1] AS skill, importance,
    (importance = 'required' AND regexp_matches(text, '(?i)must|required|mandatory')) OR CASE WHEN kind = 'experience' THEN regexp_matches(text, '(?i)must|required|minimum') WHEN kind IN ('authorization', 'clearance') THEN true WHEN kind IN ('language', 'education', 'location') THEN regexp_matches(text, '(?i)must|required') ELSE false END AS hard FROM known),
named AS (SELECT id, list(skill) AS skills FROM typed WHERE skill IS NOT NULL GROUP BY id),
fresh AS (SELECT id, unnest(ts) AS skill, unnest(range(len(ts))) AS pos FROM (SELECT id, list_filter({_techs("description")}, lambda t: NOT list_contains(coalesce(skills, []), t)) AS ts FROM post LEFT JOIN named USING (id))),
asks AS (SELECT id, trim(regexp_extract(description, '(?i)(?:authorized to work|work authorization|eligible to work)[^.\n]{{0,120}}')) AS text FROM post WHERE id NOT IN (SELECT id FROM typed WHERE type = 'authorization')),
every AS (SELECT * FROM typed UNION ALL SELECT id, 4, pos, 'skill', 'Experience with ' || skill, skill, 'required', false FROM fresh
    UNION ALL SELECT id, 5, 0, 'location', location, NULL, 'required', regexp_matches(location || description, '(?i)must be located|on.?site only') FROM post WHERE location <> ''
    UNION ALL SELECT id, 6, 0, 'authorization', text, NULL, 'required', true FROM asks WHERE text <> ''),
asked AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY block, pos) - 1 AS pos, type, text, skill, importance, hard FROM every)"""


def _structured(spark, sf_dir):
    return requirements.structured(requirements.extract(posts(spark, sf_dir)))


@query(f"WITH {_REQUIREMENTS} SELECT id, pos, type, text, skill, importance, hard FROM asked")
def requirements_structured(spark, sf_dir):
    return _structured(spark, sf_dir).select("id", F.posexplode_outer("requirements").alias("pos", "r")).filter("pos is not null").select("id", "pos", "r.*")


_RELATED = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in matching.RELATED.items()) + "}"
_MATCHES = rf"""{_REQUIREMENTS},
person AS (SELECT *, list_transform(list_concat(skills, flatten(list_transform(evidence, lambda e: e.skills))), lambda s: {_canon("s")}) AS can FROM ({PROFILES_SQL})),
pair AS (SELECT a.*, p.can, p.evidence, nullif({_canon("a.skill")}, '') AS key, list_filter(string_split(a.text, ' '), lambda w: length(w) > 4) AS long_words FROM asked a JOIN person p USING (id)),
looked AS (SELECT *, list_filter(evidence, lambda e: len(list_filter(long_words, lambda w: contains(lower(e.text), lower(w)))) > 0)[1] AS spoken, list_filter(evidence, lambda e: list_contains(list_transform(e.skills, lambda s: {_canon("s")}), key))[1] AS shown, {_RELATED}[key] AS related FROM pair),
judged AS (SELECT *, CASE WHEN type = 'location' AND hard THEN 'blocked' WHEN key IS NULL AND type = 'responsibility' AND spoken IS NOT NULL THEN 'confirmed' WHEN key IS NULL THEN 'missing_evidence' WHEN list_contains(can, key) THEN 'confirmed'
    WHEN list_has_any(coalesce(related, []), can) THEN 'transferable' WHEN len(list_filter(can, lambda s: contains(key, s) OR contains(s, key))) > 0 THEN 'transferable' WHEN key IN {tuple(matching.GAPS)} THEN 'gap' ELSE 'missing_evidence' END AS status FROM looked),
matched AS (SELECT *, CASE WHEN status = 'blocked' THEN 0.9 WHEN status = 'confirmed' THEN CASE WHEN key IS NULL THEN 0.7 ELSE 0.9 END WHEN status = 'transferable' THEN CASE WHEN list_has_any(coalesce(related, []), can) THEN 0.6 ELSE 0.5 END WHEN status = 'gap' THEN 0.8 WHEN key IS NULL THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence,
    CASE WHEN status = 'confirmed' THEN CASE WHEN key IS NULL THEN spoken.id ELSE shown.id END END AS evidence_id,
    CASE WHEN status = 'blocked' THEN 'Location requirement: ' || text WHEN status = 'gap' THEN 'No evidence of ' || key || ' in profile — qualification gap' END AS concern FROM judged)"""


def _analysed(spark, sf_dir):
    return matching.analyse(with_profile(_structured(spark, sf_dir)))


@query(f"WITH {_MATCHES} SELECT id, pos, status, confidence, evidence_id FROM matched")
def requirement_matches(spark, sf_dir):
    return matching.requirement_rows(_analysed(spark, sf_dir)).select("id", "pos", "status", "confidence", "evidence_id")


def _share(names: list[str], weight: int) -> str:
    wanted = f"key IN {tuple(names)}"
    return f"CASE WHEN count(*) FILTER ({wanted}) > 0 THEN count(*) FILTER ({wanted} AND list_contains(can, key)) / count(*) FILTER ({wanted}) * {weight} ELSE 0 END"


_SCORES = rf"""{_MATCHES},
counted AS (SELECT id, count(*) AS n, {_share(matching.CORE, 25)} AS core_skills, {_share(matching.FRAMEWORKS, 15)} AS frameworks_tools, count(*) FILTER (status = 'confirmed') / count(*) * 20 AS relevant_experience,
    CASE WHEN count(*) FILTER (type = 'responsibility') > 0 THEN count(*) FILTER (type = 'responsibility' AND status = 'confirmed') / count(*) FILTER (type = 'responsibility') * 15 ELSE 0 END AS responsibility_alignment, count(*) FILTER (type = 'education') AS educated,
    count(*) FILTER (status = 'gap' AND importance = 'required') AS gaps, count(*) FILTER (type = 'skill' OR coalesce(skill, '') <> '') AS skilled, arg_min(concern, pos) FILTER (status IN ('gap', 'blocked')) AS concern,
    arg_min(text, pos) FILTER (type = 'clearance') AS clearance, TRY_CAST(regexp_extract(arg_min(text, pos) FILTER (type = 'experience' AND regexp_matches(text, '(?i)[0-9]+\+?\s*years?')), '(?i)([0-9]+)\+?\s*years?', 1) AS INTEGER) AS asked_years FROM matched GROUP BY id),
facts AS (SELECT p.*, coalesce(years, 0) AS have, remote_preference, preferred_locations, c.* EXCLUDE (id), regexp_matches(title, '(?i)senior|staff') AS senior FROM post p JOIN person USING (id) LEFT JOIN counted c ON c.id = p.id),
scored AS (SELECT *, coalesce(core_skills, 0) AS s1, coalesce(frameworks_tools, 0) AS s2, coalesce(relevant_experience, 0) AS s3, coalesce(responsibility_alignment, 0) AS s4, CASE WHEN senior THEN CASE WHEN have >= 5 THEN 10 ELSE 5 END ELSE 8 END AS s5,
    CASE WHEN remote_preference = 'remote' AND workplace = 'remote' THEN 10 WHEN workplace = 'hybrid' THEN 7 ELSE 4 END AS s6, CASE WHEN coalesce(educated, 0) > 0 OR contains(lower(description), 'degree') THEN 4 ELSE 0 END AS s7 FROM facts),
tenths AS (SELECT *, list_transform([s1, s2, s3, s4, s5, s6, s7], lambda s: floor(s * 10 + 0.5) / 10) AS scores FROM scored)"""
_NAMES = ["core_skills", "frameworks_tools", "relevant_experience", "responsibility_alignment", "seniority_leadership", "location_work_arrangement", "education_domain"]


@query(f"WITH {_SCORES} SELECT id, unnest({quoted(_NAMES)}) AS category, unnest(scores) AS score FROM tenths")
def category_scores(spark, sf_dir):
    return matching.category_rows(_analysed(spark, sf_dir)).select("id", "category", "score")


@query(
    rf"""WITH {_SCORES},
    filtered AS (SELECT *, list_filter([CASE WHEN remote_preference = 'remote' AND workplace = 'on_site' THEN 'Role is on-site but you prefer remote work' END,
        CASE WHEN regexp_matches(location, '(?i)san francisco|new york') AND workplace <> 'remote' AND len(list_filter(preferred_locations, lambda p: contains(lower(location), lower(p)))) = 0 THEN 'Role requires location in ' || location END,
        'Requires security clearance: ' || clearance], lambda x: x IS NOT NULL) AS blocks,
        list_filter([CASE WHEN workplace = 'on_site' AND NOT regexp_matches(lower(title || ' ' || location || ' ' || description), 'canada|remote') THEN 'Role may not be Canada-based or remote' END,
        CASE WHEN asked_years > have + 3 THEN 'Role requires ' || asked_years || '+ years; profile shows ' || have END,
        CASE WHEN regexp_matches(title, '(?i)staff|principal') AND have < 8 THEN 'Staff/principal level may exceed current seniority' END], lambda x: x IS NOT NULL) AS warnings FROM tenths),
    capped AS (SELECT *, CASE WHEN len(blocks) > 0 THEN 'block' WHEN len(warnings) > 0 THEN 'warning' ELSE 'pass' END AS result, least(floor(list_sum(scores) + 0.5), CASE WHEN coalesce(n, 0) < 3 OR coalesce(skilled, 0) < 1 THEN 70 ELSE 100 END, CASE WHEN gaps >= 2 THEN 40 WHEN gaps = 1 THEN 55 ELSE 100 END)::INTEGER AS overall FROM filtered)
    SELECT id, result, overall, CASE WHEN result = 'block' THEN 'poor' WHEN overall >= 85 THEN 'excellent' WHEN overall >= 75 THEN 'strong' WHEN overall >= 60 THEN 'possible' WHEN overall >= 45 THEN 'stretch' ELSE 'poor' END AS classification, coalesce(concern, blocks[1], warnings[1]) AS top_concern FROM capped"""
)
def match_summary(spark, sf_dir):
    return _analysed(spark, sf_dir).select("id", "filter.result", "overall", "classification", "top_concern")


def _any(x: str, patterns: list[str]) -> str:
    # accented letters are no word characters on either side
    return f"regexp_matches({x}, '(?i)(^|[^A-Za-z0-9_])({'|'.join(patterns)})($|[^A-Za-z0-9_])')"


_PLACE = "location || ' ' || description[1:800]"
_REMOTE = f"(workplace = 'remote' OR {_any(_PLACE, signals.REMOTE)})"


@query(
    f"""WITH post AS ({POSTS_SQL}) SELECT id, CASE WHEN {_any(_PLACE, signals.REMOTE_CANADA)} THEN 'remote-canada' WHEN {_REMOTE} AND {_any(_PLACE, signals.US_ONLY)} THEN 'remote-us' WHEN {_REMOTE} AND {_any(_PLACE, signals.CANADA)} THEN 'remote-canada'
    WHEN {_REMOTE} AND {_any(_PLACE, signals.REGIONS)} THEN 'remote-region-specific' WHEN {_REMOTE} THEN 'remote-unknown' WHEN workplace = 'hybrid' THEN 'hybrid' WHEN {_any(_PLACE, signals.CANADA)} THEN 'onsite' ELSE 'unknown' END AS class FROM post"""
)
def location_class(spark, sf_dir):
    return posts(spark, sf_dir).select("id", signals.location_class(F.col("location"), F.col("description"), F.col("workplace")).alias("class"))


_TARGETS = "CASE WHEN id % 3 = 0 THEN ['engineer', 'Designer'] ELSE [] END"
_NEAR = "lower(location || ' ' || description[1:500])"


@query(
    rf"""WITH post AS ({POSTS_SQL}), person AS ({PROFILES_SQL}), offered AS (SELECT post.*, preferred_locations, {_TARGETS} AS targets FROM post JOIN person USING (id)),
    judged AS (SELECT *, NOT ({_any("title", signals.BLOCKED_TITLE)} OR regexp_matches(title, '(?i)\binternship')) AND CASE WHEN len(targets) > 0 THEN len(list_filter(targets, lambda t: contains(lower(title), lower(t)))) > 0 ELSE {_any("title", signals.ALLOWED_TITLE)} END AS title_fits,
    workplace = 'remote' OR {_any(_NEAR, ["remote", *signals.IMPORT_CANADA])} OR len(list_filter(preferred_locations, lambda p: contains({_NEAR}, lower(p)))) > 0 AS place_fits FROM offered)
    SELECT id, CASE WHEN NOT title_fits THEN 'title_mismatch' WHEN NOT place_fits THEN 'location_mismatch' END AS reason FROM judged"""
)
def import_filter(spark, sf_dir):
    d = with_profile(posts(spark, sf_dir))
    targets = F.when(F.col("id") % 3 == 0, F.array(F.lit("engineer"), F.lit("Designer"))).otherwise(F.array().cast("array<string>"))
    return d.select("id", signals.import_reason(F.col("title"), F.col("location"), F.col("description"), F.col("workplace"), targets, F.col("profile.preferred_locations")).alias("reason"))
