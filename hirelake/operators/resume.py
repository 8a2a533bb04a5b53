"""Resumes: layout items to lines, lines to sections, sections to contact, skills and experience blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions import resume_lines as rl
from hirelake.functions.dates import date_range
from hirelake.functions.text import blank_to_null, round_share, trim_blank
from hirelake.sources.shared import stored

EMAIL, PHONE = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?\d[\d\s().-]{7,}\d"
LINKEDIN, GITHUB, URL = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[\w/-]+", r"(?i)(?:https?://)?(?:www\.)?github\.com/[\w/-]+", r"(?i)https?://[^\s|]+"
LOCATION = r"(?i)(?:^|\|)\s*[A-Za-z .,-]+(?:Canada|USA|United States|Remote|Toronto|Vancouver|Ontario)(?![A-Za-z0-9_])"


def without_repeats(items: DataFrame) -> DataFrame:
    """items (doc, page, text, ...) without page numbers, fixed headers and texts that stand on two pages or more."""
    d = items.withColumn("_key", F.lower(trim_blank(F.col("text"))))
    often = d.filter((F.length("_key") > 0) & (F.length("_key") < 60)).groupBy("doc", "_key").agg(F.countDistinct("page").alias("pages")).filter("pages >= 2").drop("pages")
    d = d.filter(~F.col("_key").rlike(r"^\d{1,3}$") & ~F.col("_key").rlike(rl.REPEATED))
    return d.join(often, ["doc", "_key"], "left_anti").drop("_key")


def group_lines(items: DataFrame, near: float = 3.0, gap: float = 14.0) -> DataFrame:
    """doc, line_no, text: items on one page whose height is within `near` of the first item of the line. The first item
    decides, so the lines of a document are a fold over its items, which are few."""
    schema = "doc string, line_no int, text string"
    kind = dict(items.dtypes)["doc"]

    def run(pdf):
        import pandas as pd

        lines, page, height, right = [], None, 0.0, 0.0
        for r in pdf.sort_values(["page", "y", "x"], ascending=[True, False, True], kind="stable").itertuples():
            if page != r.page or abs(height - r.y) > near:
                lines.append(r.text)
                page, height = r.page, r.y
            else:
                lines[-1] += (" " if r.x - right > gap or not lines[-1].endswith(" ") else "") + r.text
            right = r.x + r.width
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]] * len(lines), "line_no": range(len(lines)), "text": [" ".join(x.split()) for x in lines]})

    return items.groupBy("doc").applyInPandas(run, schema.replace("doc string", f"doc {kind}"))


def cleaned(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, text) after repair; a line that holds two becomes two."""
    d = lines.select("doc", "line_no", F.posexplode(rl.clean_lines(F.col("text"))).alias("part", "text")).filter("text <> ''")
    order = W.partitionBy("doc").orderBy("line_no", "part")
    return d.select("doc", (F.row_number().over(order) - 1).alias("line_no"), "text")


def sections(lines: DataFrame) -> DataFrame:
    """lines with section (its type) and section_no; what stands before the first heading is contact."""
    w = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lines.withColumn("_head", rl.heading(F.col("text")))
    d = d.withColumn("section", F.coalesce(F.last("_head", ignorenulls=True).over(w), F.lit("contact"))).withColumn("section_no", F.count("_head").over(w))
    return d.filter("_head is null").drop("_head")


def outlines(parts: DataFrame) -> DataFrame:
    """Each document's sections as one text. parts: doc, section_no, section, heading and lines (an array, in order)."""
    one = F.concat(F.lit("["), "section", F.lit("] "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.array_join("lines", "\n"))
    d = parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("section_no", one.alias("text")))).alias("_parts"))
    return d.select("doc", F.array_join(F.transform("_parts", lambda x: x["text"]), "\n\n").alias("outline"))


def paired(df: DataFrame, fits: Column, doc: str, order: str) -> DataFrame:
    """Neighbours put together two by two from the top: a row that fits its next row takes it, and the pair takes no third.
    Adds _takes and _taken. In a run of rows that fit, every other one takes, so positions in the run decide."""
    w = W.partitionBy(doc).orderBy(order)
    last = F.lead(F.lit(True)).over(w).isNull()
    d = df.withColumn("_fits", F.coalesce(fits, F.lit(False)) & ~last)
    opens = F.when(F.col("_fits") & ~F.coalesce(F.lag("_fits").over(w), F.lit(False)), 1).otherwise(0)
    d = d.withColumn("_run", F.sum(opens).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    nth = F.row_number().over(W.partitionBy(doc, "_run", "_fits").orderBy(order))
    d = d.withColumn("_takes", F.col("_fits") & (nth % 2 == 1))
    return d.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False))).drop("_fits", "_run")


def merge_wrapped(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, page, text, is_bullet): one that ends in a hyphen, or runs on in lower case without a stop, takes
    its next line; numbers of lines stay those of the first."""
    w = W.partitionBy("doc").orderBy("line_no")
    t, after = trim_blank(F.col("text")), trim_blank(F.lead("text").over(w))
    hyphen = t.rlike(r"\w-$")
    same = (F.lead("page").over(w) == F.col("page")) & ~F.col("is_bullet") & ~F.lead("is_bullet").over(w)
    runs_on = same & ~after.rlike(r"^[A-Z0-9][A-Z0-9\s|@]+$") & after.rlike("^[a-z(0-9]") & (F.length(t) > 0) & ~t.rlike("[.!?:;]$")
    d = lines.withColumn("_next", after).withColumn("_hyphen", hyphen).withColumn("_on", F.coalesce(runs_on, F.lit(False)))
    d = paired(d, F.col("_hyphen") | F.col("_on"), "doc", "line_no").filter(~F.col("_taken"))
    joined = F.concat(t, F.when(F.col("_hyphen"), "").otherwise(" "), F.col("_next"))
    return d.withColumn("text", F.when(F.col("_takes"), joined).otherwise(F.col("text"))).select(*lines.columns)


BLOCK = "struct<company:string,title:string,date_text:string,location:string,header:string,lines:array<string>>"


def merge_split_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc, block_no, company, title, date_text, location, header, lines, n_bullets): the two parts of an entry that a
    parser split, such as title and dates apart from company and bullets, become one block. The first rule that fits two
    neighbours says which part of the pair is what."""
    w = W.partitionBy("doc").orderBy("block_no")
    names = ["company", "title", "date_text", "location", "header", "lines", "n_bullets"]
    d = blocks.withColumn("a", F.struct(*names)).withColumn("b", F.lead(F.struct(*names)).over(w))
    a, b = F.col("a"), F.col("b")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    dated = lambda c: F.coalesce(c.rlike(rl.YEAR_RANGE), F.lit(False))
    name = lambda x: F.coalesce(x["title"], x["header"])
    company_only = lambda x: has(name(x)) & ~has(x["company"]) & ~dated(name(x)) & ~F.contains(name(x), F.lit("|")) & ((x["n_bullets"] > 0) | ~has(x["date_text"]))
    swapped = has(a["title"]) & dated(a["title"]) & has(a["company"]) & ~dated(a["company"]) & (a["n_bullets"] == 0)
    headed = has(b["date_text"]) | dated(b["header"]) | F.contains(b["header"], F.lit("|"))
    alone = has(a["title"]) & has(a["date_text"]) & ~has(a["company"]) & (a["n_bullets"] == 0)
    both = F.concat(a["lines"], b["lines"])

    def pair(company: Column, title: Column, date: Column, place: Column, header: Column) -> Column:
        return F.struct(company.alias("company"), title.alias("title"), date.alias("date_text"), place.alias("location"), header.alias("header"), both.alias("lines")).cast(BLOCK)

    here, there = F.coalesce(a["location"], b["location"]), F.coalesce(b["location"], a["location"])
    merged = (
        F.when(b.isNull(), F.lit(None))
        .when(alone & has(b["company"]) & ~has(b["title"]) & ~has(b["date_text"]) & (b["n_bullets"] > 0), pair(b["company"], a["title"], a["date_text"], here, a["header"]))
        .when(alone & company_only(b) & (b["n_bullets"] > 0), pair(name(b), a["title"], a["date_text"], here, a["header"]))
        .when(swapped & company_only(b), pair(name(b), a["company"], F.coalesce(a["title"], a["date_text"]), here, a["header"]))
        .when(company_only(a) & headed, pair(name(a), F.coalesce(b["title"], b["company"]), F.coalesce(b["date_text"], F.when(dated(b["title"]), b["title"])), there, b["header"]))
        .when(company_only(a) & (a["n_bullets"] == 0) & (b["n_bullets"] > 0) & ~has(b["company"]) & dated(b["title"]), pair(name(a), b["company"], b["title"], b["location"], b["header"]))
    )
    d = d.withColumn("_merged", merged).withColumn("_more", F.col("b.n_bullets"))
    d = paired(d.drop("b"), F.col("_merged").isNotNull(), "doc", "block_no").filter(~F.col("_taken"))
    pick = lambda c: F.when(F.col("_takes"), F.col(f"_merged.{c}")).otherwise(F.col(c)).alias(c)
    return d.select("doc", "block_no", *(pick(c) for c in names[:-1]), (F.col("n_bullets") + F.when(F.col("_takes"), F.col("_more")).otherwise(0)).alias("n_bullets"))


def enriched(blocks: DataFrame) -> DataFrame:
    """blocks (company, title, date_text, lines) filled from their lines: each line that is no bullet is the dates, the title or
    the company, whichever is still missing and fits first; then what stands in the wrong field moves."""
    start = F.struct(F.col("company").alias("company"), F.col("title").alias("title"), F.col("date_text").alias("date_text"))
    none = lambda c: F.coalesce(c, F.lit("")) == ""

    def take(acc: Column, line: Column) -> Column:
        t = trim_blank(line)
        usable = (t != "") & ~t.rlike(rl.BULLET)
        dates = usable & none(acc["date_text"]) & rl.is_date_range(t)
        title = usable & ~dates & none(acc["title"]) & rl.is_job_title(t)
        company = usable & ~dates & ~title & none(acc["company"]) & rl.is_company(t)
        put = lambda name, when: F.when(when, t).otherwise(acc[name]).alias(name)
        return F.struct(put("company", company), put("title", title), put("date_text", dates))

    d = blocks.withColumn("_f", F.aggregate("lines", start, take))
    c, t, x = (F.col(f"_f.{k}") for k in ("company", "title", "date_text"))
    misplaced = rl.is_date_range(t) & none(x)
    d = d.withColumns({"date_text": F.when(misplaced, t).otherwise(x), "title": F.when(misplaced, F.lit(None)).otherwise(t), "company": c}).drop("_f")
    c, t = F.col("company"), F.col("title")
    turned = rl.is_date_range(t) & rl.is_job_title(c)
    d = d.withColumns({"date_text": F.when(turned, t).otherwise(F.col("date_text")), "title": F.when(turned, c).otherwise(t), "company": F.when(turned, F.lit(None)).otherwise(c)})
    promoted = rl.is_job_title(c) & none(t)
    d = d.withColumns({"title": F.when(promoted, c).otherwise(t), "company": F.when(promoted, F.lit(None)).otherwise(c)})
    named = rl.is_company(t) & none(c) & ~rl.is_job_title(t)
    return d.withColumns({"company": F.when(named, t).otherwise(c), "title": F.when(named, F.lit(None)).otherwise(t)})


def merge_fragments(entries: DataFrame) -> DataFrame:
    """entries (doc, entry_no, company, title, start_text, achievements): an entry of metadata alone and the next one of company
    and achievements are one; entries with nothing in them go."""
    w = W.partitionBy("doc").orderBy("entry_no")
    names = ["company", "title", "start_text", "achievements"]
    d = entries.withColumn("b", F.lead(F.struct(*names)).over(w))
    b, title, company = F.col("b"), F.col("title"), F.col("company")
    bare = F.size("achievements") == 0
    dated = rl.is_date_range(title)
    turned = dated & rl.is_job_title(company) & bare
    told = ((F.coalesce("start_text", F.lit("")) != "") | dated) & ((F.coalesce(title, F.lit("")) != "") | (F.coalesce(company, F.lit("")) != "")) & bare
    full = F.size(b["achievements"]) > 0
    firm = rl.is_company(b["title"]) & (F.coalesce(b["company"], F.lit("")) == "")
    same = (turned & firm & full & ~rl.is_date_range(b["title"])) | (told & (rl.is_company(b["company"]) | firm) & full)
    d = paired(d, same, "doc", "entry_no").filter(~F.col("_taken"))
    firm_of = F.coalesce(b["company"], F.when(rl.is_company(b["title"]), b["title"]), company)
    title_of = F.when(rl.is_job_title(company), company).when((F.coalesce(title, F.lit("")) != "") & ~dated, title).when(rl.is_job_title(b["title"]), b["title"]).otherwise(title)
    start_of = F.when(dated, title).otherwise(F.col("start_text"))
    pick = lambda name, c: F.when(F.col("_takes"), c).otherwise(F.col(name)).alias(name)
    d = d.select("doc", "entry_no", pick("company", firm_of), pick("title", title_of), pick("start_text", start_of), pick("achievements", F.concat("achievements", b["achievements"])))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return d.filter(some("company") | some("title") | some("start_text") | (F.size("achievements") > 0))


def merged_warnings(*groups: Column) -> Column:
    """Warnings (code, field, message) of several arrays, each once, in order."""
    return F.array_distinct(F.concat(*groups))


def lines_of(df: DataFrame, section: str) -> DataFrame:
    """doc and its lines in a section as an array; of a section that is there twice the later one."""
    d = df.filter(F.col("section") == section).groupBy("doc", "section_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    return d.groupBy("doc").agg(F.max_by("lines", "section_no").alias("lines"))


def contact(lines: Column) -> Column:
    """struct of full_name, headline, email, phone, location, linkedin, github, portfolio from the lines before the first heading."""
    text = F.array_join(lines, "\n")
    first = lambda p: blank_to_null(F.regexp_extract(text, p, 0))
    linkedin, github = first(LINKEDIN), first(GITHUB)
    urls = F.filter(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: ~F.coalesce(F.contains(linkedin, u), F.lit(False)) & ~F.coalesce(F.contains(github, u), F.lit(False)))
    plain = F.filter(lines, lambda x: ~(x.rlike(EMAIL) | x.rlike(PHONE) | x.rlike(LINKEDIN) | x.rlike(GITHUB) | x.rlike(URL)))
    place = F.get(F.filter(lines, lambda x: x.rlike(LOCATION)), 0)
    return F.struct(
        trim_blank(F.get(plain, 0)).alias("full_name"),
        F.when(F.length(F.get(plain, 1)) < 80, trim_blank(F.get(plain, 1))).alias("headline"),
        first(EMAIL).alias("email"),
        trim_blank(first(PHONE)).alias("phone"),
        trim_blank(F.regexp_replace(place, r"(?i)^location:\s*", "")).alias("location"),
        linkedin.alias("linkedin"),
        github.alias("github"),
        F.get(urls, 0).alias("portfolio"),
    )


def skill_groups(lines: DataFrame) -> DataFrame:
    """doc, group_no, category and skills of the lines of a skills section. A line "Category: a, b" or "Category:" opens a
    group, other lines add to the last one."""
    t = F.col("text")
    pair, bare = t.rlike(r"^[A-Za-z][A-Za-z\s/&]+:\s*.*,"), t.endswith(":") & (F.length(t) < 40)
    opens = pair | bare
    w = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lines.withColumn("group_no", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    category = F.when(pair, trim_blank(F.regexp_extract(t, r"^([A-Za-z][A-Za-z\s/&]+):", 1))).when(bare, trim_blank(F.regexp_replace(t, ":$", "")))
    rest = F.when(pair, F.regexp_replace(t, r"^[A-Za-z][A-Za-z\s/&]+:\s*", "")).when(bare, F.lit("")).otherwise(t)
    listed = F.filter(F.transform(F.when(rest.contains(","), F.split(rest, r"[,;|]")).otherwise(F.array(rest)), trim_blank), lambda x: x != "")
    d = d.withColumn("_category", category).withColumn("_skills", listed)
    g = d.groupBy("doc", "group_no").agg(F.max("_category").alias("category"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_skills"))), lambda x: x["_skills"])).alias("skills"))
    return g.filter(F.size("skills") > 0)


def experience_blocks(lines: DataFrame) -> DataFrame:
    """doc, block_no, title, company, dates and bullets of the lines of an experience section. A line with a bar, a date
    range or, before a bullet or a date, a title or company starts an entry; header lines in a row belong to one entry."""
    t = F.col("text")
    order = W.partitionBy("doc").orderBy("line_no")
    bullet = t.rlike(rl.BULLET) | (rl.is_achievement(t) & ~rl.is_job_title(t))
    d = lines.withColumn("_bullet", bullet & ~rl.is_date_range(t))
    head = ~F.col("_bullet") & (rl.is_date_range(t) | t.contains("|") | rl.is_job_title(t) | rl.is_company(t))
    d = d.withColumn("_head", head).withColumn("_before", F.coalesce(F.lag("_head").over(order), F.lit(False)))
    starts = F.col("_head") & ~F.col("_before")
    d = d.withColumn("block_no", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = F.when(F.col("_head"), F.filter(F.transform(F.split(t, r"\|"), trim_blank), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_parts", parts).withColumn("_text", F.when(~F.col("_head"), t))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col(c).alias("v")))), lambda x: x["v"])
    b = d.groupBy("doc", "block_no").agg(F.flatten(in_order("_parts")).alias("head"), F.filter(in_order("_text"), lambda x: x.isNotNull()).alias("body"))
    find = lambda test: F.get(F.filter("head", test), 0)
    title, dates = find(rl.is_job_title), find(rl.is_date_range)
    company = find(lambda x: rl.is_company(x) & ~rl.is_location(x))
    return b.select("doc", "block_no", title.alias("title"), company.alias("company"), dates.alias("date_text"), rl.kept_bullets(F.col("body")).alias("bullets")).filter("title is not null or company is not null or date_text is not null or size(bullets) > 0")


def reconciled(blocks: DataFrame) -> DataFrame:
    """Experience rows whose title and company were swapped put right, with start, end and current."""
    swapped = rl.is_date_range(F.col("title"))
    d = blocks.withColumn("date_text", F.when(swapped, F.coalesce("title", "date_text")).otherwise(F.col("date_text")))
    promoted = swapped & rl.is_job_title(F.col("company"))
    d = d.withColumn("_title", F.when(promoted, F.col("company")).otherwise(F.col("title"))).withColumn("company", F.when(promoted, F.lit(None)).otherwise(F.col("company")))
    return d.withColumn("title", F.col("_title")).drop("_title").withColumn("dates", date_range(F.col("date_text")))


def parsed(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, text) to one row per doc: contact, summary, skill_groups and experience, each from its section.
    A doc without a section has a null there, or no entries."""
    s = sections(lines)
    order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["row"])
    fields = lambda *names: F.struct(*names)
    c = lines_of(s, "contact").select("doc", contact(F.col("lines")).alias("contact"))
    summary = lines_of(s, "summary").select("doc", F.array_join("lines", " ").alias("summary"))
    g = skill_groups(s.filter("section = 'skills'")).select("doc", F.struct("group_no", fields("category", "skills").alias("row")).alias("x")).groupBy("doc").agg(order("x").alias("skill_groups"))
    e = reconciled(experience_blocks(s.filter("section = 'experience'"))).select("doc", F.struct("block_no", fields("title", "company", "dates", "bullets").alias("row")).alias("x")).groupBy("doc").agg(order("x").alias("experience"))
    return lines.select("doc").distinct().join(c, "doc", "left").join(summary, "doc", "left").join(g, "doc", "left").join(e, "doc", "left")


def confidence(contact_fields: Column, has_summary: Column, n_skills: Column, bullets: Column, has_education: Column, has_certifications: Column, warnings: Column) -> Column:
    """struct of six section scores and the overall one. bullets: per experience, how many it has."""
    penalty = F.least(warnings * 0.05, F.lit(0.35))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    n = F.size(bullets)
    filled = F.aggregate(bullets, F.lit(0.0), lambda a, b: a + F.when(b > 0, 1.0).otherwise(0.5))
    parts = {
        "contact": clamp(contact_fields / 3 - penalty),
        "summary": F.when(has_summary, F.greatest(F.lit(0.5), 0.85 - penalty)).otherwise(F.lit(0.3)),
        "skills": F.when(n_skills > 0, F.greatest(F.lit(0.4), F.least(F.lit(1.0), n_skills / 10))).otherwise(F.lit(0.2)),
        "experience": F.when(n > 0, F.greatest(F.lit(0.4), F.least(F.lit(1.0), filled / n) - penalty)).otherwise(F.lit(0.2)),
        "education": F.when(has_education, 0.75 - penalty).otherwise(F.lit(0.3)),
        "certifications": F.when(has_certifications, 0.75 - penalty).otherwise(F.lit(0.3)),
    }
    total = F.lit(0.0)
    for c in parts.values():
        total = total + c
    overall = F.greatest(F.lit(0.0), total / 6 - penalty)
    return F.struct(round_share(overall).alias("overall"), *(round_share(c).alias(k) for k, c in parts.items()))


def tailoring_bullets(bullets: DataFrame, jobs: DataFrame, n: int = 8) -> DataFrame:
    """For each job the n bullets of its candidate that fit best. bullets: user, pos, text; jobs: job, user, description.
    A user's bullets of the same words and marks get the same points from every job, so they are one kind, of which only the
    first n can be among a job's n; and of the kinds only the first n can hold one. Kinds are written first, so that a user of
    very many jobs can be split in the join."""
    d = bullets.filter(rl.is_tailorable(F.col("text"))).select("user", "pos", "text", rl.bullet_words(F.col("text")).alias("words"), rl.bullet_marks(F.col("text")).alias("marks"))
    nth = F.row_number().over(W.partitionBy("user", "words", "marks").orderBy("pos"))
    d = d.withColumn("nth", nth).filter(F.col("nth") <= n)
    kinds = d.groupBy("user", "words", "marks").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("same"))
    kinds = stored(bullets.sparkSession, kinds.withColumn("kind", F.monotonically_increasing_id()), "bullets")
    known = kinds.select("user", "words", "marks", "kind", F.get("same", 0)["pos"].alias("first"), F.size("same").alias("n"))
    d = jobs.select("job", "user", F.lower("description").alias("low")).join(known, "user")
    d = d.select("job", rl.bullet_score(F.col("words"), F.col("marks"), F.col("low")).alias("points"), "kind", "first", "n")
    best = W.partitionBy("job").orderBy(F.col("points").desc(), "first")
    d = d.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n)
    # how many bullets of more points there are
    ahead = F.sum("n").over(W.partitionBy("job").orderBy(F.col("points").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(W.partitionBy("job", "points"))
    d = d.withColumn("ahead", ahead).filter(F.col("ahead") < n).select("job", "points", "kind")
    d = d.join(kinds.select("kind", "same"), "kind").select("job", "points", F.inline("same"))
    w = W.partitionBy("job").orderBy(F.col("points").desc(), F.col("pos"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("job", "rank", "pos", "text", "points")
