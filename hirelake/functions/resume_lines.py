"""What a line of a resume is: contact, heading, bullet, date range, title, company, achievement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import any_of, collapse_blanks, normalize_unicode, repair_hyphens, trim_blank, word

# Patterns of line kinds.
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
DAY_OR_MONTH = rf"(?:{MONTH}|\d{{1,2}})[\s./-]*\d{{2,4}}"
RANGE = rf"(?i)(?<![A-Za-z0-9_]){DAY_OR_MONTH}(?![A-Za-z0-9_])[\s–—-]+.*(?<![A-Za-z0-9_])(?:present|current|{DAY_OR_MONTH}|\d{{2,4}})(?![A-Za-z0-9_])"
TITLE = word(r"(?:(?:senior|lead|staff|principal|junior)\s+)?(?:(?:software|frontend|front end|front-end|full stack|fullstack|backend|back end|web|ui|product|full-stack)\s+)?(?:developer|engineer|instructor|architect|consultant|designer|manager)")
VERBS = "built|developed|led|designed|implemented|migrated|shipped|improved|reduced|increased|delivered|owned|architected|created|maintained|collaborated|optimized|automated|scaled|mentored|launched"
ACHIEVED, DONE = word(VERBS + "|worked|contributed|achieved"), word(VERBS)
PLACE = word("remote|canada|toronto|lagos|ontario|usa|united states")
CONTACT = [r"^[\w.+-]+@[\w.-]+\.\w+$", r"@\w+\.\w+", word(r"linkedin\.com|github\.com"), r"^\+?\d[\d\s().-]{7,}\d$", r"(?i)^(?:https?://|www\.)"]
NOT_TAILORED = [r"^[\w.+-]+@[\w.-]+\.\w+$", r"@\w+\.\w+", word(r"linkedin\.com|github\.com|portfolio"), r"^\+?\d[\d\s().-]{7,}\d$", r"^\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$", r"(?i)^(?:https?://|www\.)", r"(?i)^(?:resume|curriculum vitae|cv)$"]
HEADER = r"(?i)^(?:experience|work experience|employment|education|skills|projects|summary|contact|certifications|technical skills)$"
BULLET = r"^[-•*–—]\s+"
HEADINGS = {
    "summary": "summary|professional summary|career objective|profile|about me",
    "skills": "skills|technical skills|core technical skills|core skills|competencies",
    "experience": "experience|work experience|professional experience|employment history|work history",
    "education": "education",
    "certifications": "certifications|certificates|licenses",
    "projects": "projects",
}
REPEATED = r"(?i)^(?:page \d+ of \d+|confidential|resume|curriculum vitae)$"
METRIC = r"\d+%|\d+x|\$\d|#\d|\d+\+"
CLAIMS = [word(r"\d+\+?\s*years?\s+(?:of\s+)?experience"), r"(?i)(?<![A-Za-z0-9_])(?:led|managed|architected|built|shipped)(?![A-Za-z0-9_])[^.!?]{0,80}"]
CLAIM_TECHS = r"(?<![A-Za-z0-9_])(?:react|typescript|graphql|kubernetes|java|python|aws|node\.?js)(?![A-Za-z0-9_])"
CLAIM_TEXT, TECH_TEXT = ('Verify claim: "', '"'), ('"', '" mentioned in answer but not in cited evidence')
YEAR_RANGE = r"(?i)(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?\d{4}\s*[-–—]\s*(?:present|current|(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?\d{4}|\d{1,2}/\d{4})"


def heading(line: Column) -> Column:
    """The section a heading line opens; null for other lines."""
    t = trim_blank(line)
    return F.when(F.length(t) <= 60, F.coalesce(*(F.when(t.rlike(rf"(?i)^(?:{p})$"), name) for name, p in HEADINGS.items())))


def is_date_range(line: Column) -> Column:
    return F.coalesce(trim_blank(line).rlike(RANGE), F.lit(False))


def is_job_title(line: Column) -> Column:
    t = trim_blank(line)
    return F.coalesce((F.length(t) <= 80) & t.rlike(TITLE) & ~is_date_range(t), F.lit(False))


def experience_issues(title: Column, company: Column) -> Column:
    """What is in the wrong field of a job: title_has_dates, company_has_dates, company_has_title."""
    tests = {"title_has_dates": title.rlike(RANGE), "company_has_dates": company.rlike(RANGE), "company_has_title": company.rlike(TITLE)}
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items())), lambda x: x.isNotNull())


def is_company(line: Column) -> Column:
    t = trim_blank(line)
    return F.coalesce(F.length(t).between(2, 120) & ~is_date_range(t) & ~is_job_title(t) & ~t.endswith(".") & ~(t.rlike(ACHIEVED) & (F.length(t) > 40)), F.lit(False))


def is_achievement(line: Column) -> Column:
    t = trim_blank(line)
    return F.coalesce((F.length(t) > 0) & ~is_date_range(t) & (t.rlike(ACHIEVED) | ((F.length(t) > 35) & t.rlike("[.!]"))), F.lit(False))


def is_location(line: Column) -> Column:
    return F.coalesce(trim_blank(line).rlike(PLACE), F.lit(False))


def is_contact_or_header(line: Column) -> Column:
    t = trim_blank(line)
    return (F.length(t) < 3) | any_of(t, CONTACT) | t.rlike(HEADER) | t.rlike(r"(?i)^\d{4}\s*[-–—]\s*(?:present|\d{4})")


def is_bullet(line: Column) -> Column:
    t = trim_blank(line)
    return (F.length(t) > 0) & ~is_contact_or_header(t) & (t.rlike(BULLET) | (t.rlike(ACHIEVED) & (F.length(t) >= 20)))


def bullet_text(line: Column) -> Column:
    return trim_blank(F.regexp_replace(trim_blank(line), BULLET, ""))


def kept_bullets(lines: Column) -> Column:
    """Bullets of an array of lines; the mark is gone before a line is judged, so it no longer helps."""
    clean = F.filter(F.transform(lines, bullet_text), lambda t: (F.length(t) > 0) & ~is_contact_or_header(t))
    return F.filter(clean, lambda t: is_bullet(t) | (F.length(t) >= 40))


def split_date_title(line: Column) -> Column:
    """A date range run into a title as two lines."""
    a = r"(?i)^(\d{1,2}/\d{4}\s*[-–—]\s*(?:present|\d{1,2}/\d{4}))(.+)$"
    b = r"(?i)^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\s*[-–—]\s*(?:Present|\d{4}))(.+)$"
    two = lambda p: F.array(trim_blank(F.regexp_extract(line, p, 1)), trim_blank(F.regexp_extract(line, p, 2)))
    return F.when(line.rlike(a), two(a)).when(line.rlike(b), two(b)).otherwise(F.array(line))


def clean_lines(line: Column) -> Column:
    """A line after repair, as one line or two."""
    return F.transform(split_date_title(collapse_blanks(normalize_unicode(repair_hyphens(line)))), trim_blank)


def is_tailorable(bullet: Column) -> Column:
    t = trim_blank(bullet)
    parts = F.transform(F.split(t, r"\|"), trim_blank)
    bare = ~t.rlike(DONE) & (F.size(F.split(t, r"\s+")) < 8)
    header = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p) < 40) & ~t.rlike(DONE)
    return (F.length(t) >= 28) & ~any_of(t, NOT_TAILORED) & ~bare & ~header


def bullet_words(bullet: Column) -> Column:
    """The words over three letters, in lower case and sorted; repeats stay."""
    return F.array_sort(F.filter(F.split(F.lower(bullet), r"\W+"), lambda w: F.length(w) > 3))


def bullet_marks(bullet: Column) -> Column:
    """Two points for a verb, one for a number."""
    return F.when(bullet.rlike(DONE), 2).otherwise(0) + F.when(bullet.rlike(METRIC), 1).otherwise(0)


def bullet_score(words: Column, marks: Column, low: Column) -> Column:
    """A point for each of bullet_words() that the posting has (low: its text in lower case), and bullet_marks()."""
    return F.coalesce(F.size(F.filter(words, lambda w: F.contains(low, w))), F.lit(0)) + marks


def unsupported_claims(answer: Column, evidence: Column, job: Column) -> Column:
    """Up to five claims of an answer that its evidence doesn't hold."""
    shown = F.lower(evidence)
    said = F.concat(*(F.transform(F.regexp_extract_all(answer, F.lit(p), F.lit(0)), trim_blank) for p in CLAIMS))
    open_ = F.filter(said, lambda c: (F.length(c) > 8) & ~F.contains(shown, F.substring(F.lower(c), 1, 20)))
    phrases = F.transform(open_, lambda c: F.concat(F.lit(CLAIM_TEXT[0]), F.substring(c, 1, 60), F.when(F.length(c) > 60, "…").otherwise(""), F.lit(CLAIM_TEXT[1])))
    asked = F.array_distinct(F.regexp_extract_all(F.lower(job), F.lit(CLAIM_TECHS), F.lit(0)))
    techs = F.filter(asked, lambda t: F.contains(F.lower(answer), t) & ~F.contains(shown, t))
    return F.slice(F.concat(phrases, F.transform(techs, lambda t: F.concat(F.lit(TECH_TEXT[0]), t, F.lit(TECH_TEXT[1])))), 1, 5)
