"""Import of single postings: what an input is, pasted texts and forms to postings, limits, and messages for failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, clean_title, decode_entities, html_title, html_to_text, once, trim_blank, word
from hirelake.operators import boards, requirements
from hirelake.sources.shared import stored

# Kinds of inputs in the order that decides between equals, the limits of a posting, and messages.
BOARDS = {"greenhouse": r"(?i)greenhouse\.io", "lever": r"(?i)(?:jobs|api)\.lever\.co", "ashby": r"(?i)jobs\.ashbyhq\.com|api\.ashbyhq\.com/posting-api/job-board"}
WORKPLACES = ["remote", "hybrid", "on_site", "unknown"]
NEEDED = {"company": 200, "title": 120}
LONGEST = {"location": 200, "source_job_id": 200, "date_posted": 50, "employment_type": 100, "experience": 2000, "education": 2000}
LISTS = {"responsibilities": (100, 2000), "required": (100, 2000), "preferred": (100, 2000), "technologies": (50, 100)}
DESCRIPTION_MOST, PAYLOAD_MOST = 50_000, 100_000
REACH = "Couldn't reach that URL. Try pasting the job description instead."
LARGE = "Import too large. Shorten the description or remove extra content."
INVALID = "Some fields look invalid. Check title, company, and description length."
SIGNED_OUT = "You must be signed in to import jobs."
FAILED = "Import failed. Check your input and try again."


def is_form(text: Column) -> Column:
    """Whether a text is a JSON object."""
    t = trim_blank(text)
    return F.coalesce(t.startswith("{") & F.try_parse_json(t).isNotNull(), F.lit(False))


def provider_of(text: Column) -> Column:
    """The kind of an input: of those that fit best the first. What fits nothing counts as a form."""
    t = trim_blank(text)
    url = t.rlike(r"(?i)^https?://")
    out = F.when(is_form(text), "manual")
    for name, pattern in BOARDS.items():
        out = out.when(text.rlike(pattern), name)
    return out.when(~url & ~t.startswith("{"), "pasted_description").when(url, "generic_web").otherwise("manual")


def raw_text(text: Column) -> Column:
    """A pasted text as plain text."""
    marked = lambda t: t.rlike(r"<[^>]+>") | t.rlike(r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|\w+);")
    return once(trim_blank(text), lambda t: F.when(marked(t), html_to_text(t)).otherwise(decode_entities(t)))


def from_text(texts: DataFrame) -> DataFrame:
    """id and text to postings: named fields of the text, else its first line as title."""
    return from_plain(texts.select("id", raw_text(F.col("text")).alias("description")))


def from_plain(d: DataFrame) -> DataFrame:
    """id and description (plain text, that stays as it is) to postings. Other columns stay."""
    others = [c for c in d.columns if c not in ("id", "description")]
    said = lambda p: blank_to_null(trim_blank(F.regexp_extract("description", rf"(?i)(?:{p})[:\s]+([^\n]+)", 1)))
    first = F.coalesce(F.get(F.filter(F.transform(F.split("description", "\n"), trim_blank), lambda x: x != ""), 0), F.lit(""))
    title = F.coalesce(said("title|position|role"), F.when(F.length(first) <= 120, first))
    d = d.select(
        "id",
        F.coalesce(clean_title(said("company|organization"), "Unknown Company"), F.lit("Unknown Company")).alias("company"),
        F.coalesce(clean_title(title), F.lit("Untitled Role")).alias("title"),
        said("location").alias("location"),
        F.when(F.col("description").rlike("(?i)remote"), "remote").otherwise("unknown").alias("workplace"),
        "description",
        *others,
    )
    return requirements.extract(d)


def from_page(pages: DataFrame) -> DataFrame:
    """id, text and page_title (of a web page) to postings; a page title that fits wins. The text is plain already; what stands
    at the place where a long one is cut stays, blanks too."""
    d = from_plain(pages.select("id", F.substring("text", 1, DESCRIPTION_MOST).alias("description"), "page_title"))
    given = blank_to_null(clean_title(F.coalesce("page_title", F.lit("")), ""))
    return d.withColumn("title", F.coalesce(given, "title")).drop("page_title")


FORM = "struct<company:string,title:string,location:string,workplaceType:string,salaryMin:double,salaryMax:double,salaryCurrency:string,jobUrl:string,sourceJobId:string,datePosted:string,employmentType:string,description:string,responsibilities:array<string>,requiredQualifications:array<string>,preferredQualifications:array<string>,technologies:array<string>,experienceRequirements:string,educationRequirements:string>"
NAMES = {"workplaceType": "workplace", "salaryMin": "salary_min", "salaryMax": "salary_max", "salaryCurrency": "salary_currency", "jobUrl": "job_url", "sourceJobId": "source_job_id", "datePosted": "date_posted", "employmentType": "employment_type", "requiredQualifications": "required", "preferredQualifications": "preferred", "experienceRequirements": "experience", "educationRequirements": "education"}


def from_form(forms: DataFrame) -> DataFrame:
    """id and text (a JSON object) to postings."""
    return with_defaults(forms.select("id", F.from_json("text", FORM).alias("f")).select("id", "f.*").withColumnsRenamed(NAMES))


def with_defaults(postings: DataFrame) -> DataFrame:
    """Currency and empty lists where there is none."""
    d = postings.withColumn("salary_currency", F.coalesce("salary_currency", F.lit("CAD"))) if "salary_currency" in postings.columns else postings.withColumn("salary_currency", F.lit("CAD"))
    none = F.array().cast("array<string>")
    return d.withColumns({c: F.coalesce(c, none) for c in LISTS if c in d.columns})


def broken_limits(postings: DataFrame, confirmed: bool = False) -> Column:
    """Names of the fields of a posting that break a limit, in order; confirmed adds those of a confirmed import.
    Lengths are code points."""
    have = set(postings.columns)
    tests = [(c, F.coalesce(~F.length(c).between(1, most), F.lit(True))) for c, most in NEEDED.items()]
    tests += [(c, F.length(c) > most) for c, most in LONGEST.items() if c in have]
    tests.append(("workplace", ~F.col("workplace").isin(WORKPLACES)))
    if "job_url" in have:
        tests.append(("job_url", (F.col("job_url") != "") & ~F.col("job_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")))
    tests.append(("description", F.coalesce(F.length("description") < 1, F.lit(True)) | (F.lit(confirmed) & (F.length("description") > DESCRIPTION_MOST))))
    if confirmed:
        tests += [(c, (F.size(c) > n) | F.exists(c, lambda x: F.length(x) > most)) for c, (n, most) in LISTS.items() if c in have]  # noqa: B023
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests)), lambda x: x.isNotNull())


def single(raw: DataFrame) -> DataFrame:
    """Postings of payloads with one posting: raw has id, provider, url, text and payload. {"job": ...} or, of greenhouse
    and lever, a bare posting, or, of ashby, a list of one; any other payload gives a posting of the board's text."""
    wrapped = F.get_json_object("payload", "$.job").isNotNull()
    listed = F.when(F.size(F.from_json(F.get_json_object("payload", "$.jobs"), "array<string>")) == 1, F.get_json_object("payload", "$.jobs[0]"))
    job = F.when(wrapped, F.get_json_object("payload", "$.job")).when(F.col("provider") == "ashby", listed).when(F.when(F.col("provider") == "lever", F.get_json_object("payload", "$.text")).otherwise(F.get_json_object("payload", "$.title")).isNotNull(), F.col("payload"))
    d = raw.withColumn("_job", job)
    field = lambda p: F.get_json_object("_job", p)
    outer = lambda p: F.get_json_object("payload", p)
    named = F.coalesce(outer("$.companyName"), boards.board_name(outer("$.board")), F.lit("Company"))
    is_lever, is_ashby = F.col("provider") == "lever", F.col("provider") == "ashby"
    body = F.when(is_lever, html_to_text(field("$.text"))).when(is_ashby, html_to_text(F.coalesce(field("$.descriptionHtml"), F.lit("")))).otherwise(html_to_text(field("$.content")))
    line = F.get(F.filter(F.transform(F.split(body, "\n"), trim_blank), lambda x: x != ""), 0)
    place = F.when(is_lever, field("$.categories.location")).when(is_ashby, field("$.location")).otherwise(field("$.location.name"))
    remote = F.when(F.coalesce(place, F.lit("")).rlike("(?i)remote"), "remote").otherwise("unknown")
    company = F.when(is_lever, F.coalesce(clean_title(field("$.categories.team"), "Company"), F.lit("Company"))).when(is_ashby | wrapped, named).otherwise(F.coalesce(field("$.departments[0].name"), F.lit("Company")))
    one = {
        "company": company,
        "title": F.coalesce(clean_title(F.when(is_lever, line).otherwise(field("$.title"))), F.lit("Untitled Role")),
        "location": place,
        "workplace": F.when(is_ashby, boards.workplace_type(field("$.isRemote") == "true", field("$.workplaceType"), place)).otherwise(remote),
        "job_url": F.when(is_lever, F.coalesce(field("$.hostedUrl"), "url")).when(is_ashby, field("$.jobUrl")).otherwise(field("$.absolute_url")),
        "source_job_id": field("$.id"),
        "description": F.when(is_ashby, F.coalesce(blank_to_null(body), field("$.title"))).otherwise(body),
    }
    board = {
        "company": F.when(is_ashby, F.coalesce(outer("$.companyName"), F.lit("Ashby Board"))).when(is_lever, "Lever Board").otherwise("Greenhouse Board"),
        "title": F.lit("Multiple Positions"),
        "location": F.lit(None).cast("string"),
        "workplace": F.lit(None).cast("string"),
        "job_url": F.col("url"),
        "source_job_id": F.lit(None).cast("string"),
        "description": html_to_text(F.col("text")),
    }
    d = d.select("id", "provider", *(F.when(F.col("_job").isNotNull(), one[c]).otherwise(board[c]).alias(c) for c in one))
    return requirements.extract(d)


IMPORTED = {"company": "string", "title": "string", "location": "string", "workplace": "string", "salary_min": "double", "salary_max": "double", "salary_currency": "string", "job_url": "string", "source_job_id": "string", "date_posted": "string", "employment_type": "string", "description": "string", "responsibilities": "array<string>", "required": "array<string>", "preferred": "array<string>", "technologies": "array<string>", "experience": "string", "education": "string"}


def import_jobs(inputs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every input (id, input: an address, a pasted text or a form) as a posting: what it is, what its address gave, and the
    posting of that kind. fetched: url and payload (the page, or the board's JSON; null where nothing came). Gives id,
    provider, error, message and IMPORTED.

    An address of a board must give JSON, else the import has failed; a web page that can't be fetched becomes a posting
    that says so. A posting that breaks a limit is invalid. Each kind of input is read once from a written table, so an
    address is joined once, whatever the kinds."""
    url = F.when(F.col("provider").isin(*BOARDS, "generic_web"), trim_blank(F.col("input")))
    d = inputs.select("id", "input").withColumn("provider", provider_of(F.col("input"))).withColumn("url", url)
    d = stored(inputs.sparkSession, d.join(fetched.select("url", "payload"), "url", "left"), "imports")
    is_board, is_page = F.col("provider").isin(*BOARDS), F.col("provider") == "generic_web"
    error = F.when(is_board & F.col("payload").isNull(), "could not reach the board").when(is_board & F.try_parse_json("payload").isNull(), "invalid payload").when(is_board & (F.length("payload") > PAYLOAD_MOST), "payload too large").when((F.col("provider") == "manual") & ~is_form(F.col("input")), "invalid form")
    d = d.withColumn("error", error)
    good = d.filter("error IS NULL")
    unreached = F.concat(F.lit("Failed to fetch URL: "), F.col("url"), F.lit(". Please paste the job description directly."))
    pages = good.filter(is_page).select("id", F.when(F.col("payload").isNull(), unreached).otherwise(html_to_text(F.col("payload"))).alias("text"), html_title(F.col("payload")).alias("page_title"))
    kinds = [
        from_text(good.filter(F.col("provider") == "pasted_description").select("id", F.col("input").alias("text"))),
        from_page(pages),
        from_form(good.filter(F.col("provider") == "manual").select("id", F.col("input").alias("text"))),
        single(good.filter(is_board).select("id", "provider", "url", F.col("payload").alias("text"), "payload")),
    ]
    out = None
    for k in kinds:
        k = k.select("id", *(F.col(c).cast(t).alias(c) if c in k.columns else F.lit(None).cast(t).alias(c) for c, t in IMPORTED.items()))
        out = k if out is None else out.unionByName(k)
    out = d.select("id", "provider", "error", "url").join(with_defaults(out), "id", "left")
    out = out.withColumn("job_url", F.coalesce("job_url", F.when(is_page, F.col("url"))))
    broken = F.array_join(broken_limits(out), ", ")
    out = out.withColumn("error", F.coalesce("error", F.when(broken != "", F.concat(F.lit("invalid: "), broken))))
    return out.select("id", "provider", "error", F.when(F.col("error").isNotNull(), failure_message(F.col("error"))).alias("message"), *IMPORTED)


def failure_message(message: Column) -> Column:
    """What to tell about a failed import."""
    low = F.lower(message)
    return (
        F.when(low.rlike("fetch|network|enotfound|could not reach"), REACH)
        .when(low.rlike("(?:payload|import) too large"), LARGE)
        .when(low.rlike("zod|too big|too long") | low.rlike(word("invalid|expected string")), INVALID)
        .when(low.contains("unauthorized"), SIGNED_OUT)
        .otherwise(FAILED)
    )
