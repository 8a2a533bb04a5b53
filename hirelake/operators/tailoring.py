"""Suggestions for the bullets of a resume, made for a posting, and the check of suggestions that others have made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.skills import technologies
from hirelake.functions.text import trim_blank

# How a suggestion words what it emphasises, how sure it is, and how many there are.
NAMED, UNNAMED = " (Emphasize for role: {})", " — highlight overlap with {} where accurate"
SURE, LESS_SURE = 0.55, 0.4
BULLETS, TECHS, SHOWN = 5, 6, 3
TYPES = ["rewrite", "emphasize", "reorder"]
# Jobs and evidence in a block, and jobs (with a text) that a task gets: a file's dictionary of a million bytes holds them.
JOBS, EVIDENCE, JOBS_A_TASK = 4096, 1024, 50_000
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _worded(pattern: str, names):
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), names, F.lit(after))


def suggestions(ranked: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each posting's best bullets what to emphasise: the technologies of the posting that the bullet has, else the first
    ones of the posting. ranked: job, rank, id, text (resume.tailoring_bullets); jobs: job, description. A posting without
    technologies changes nothing, so its bullets give none. Other columns of ranked stay."""
    others = [c for c in ranked.columns if c not in ("job", "rank", "id", "text")]
    asked = jobs.select("job", F.slice(technologies(F.coalesce("description", F.lit(""))), 1, TECHS).alias("_asked"))
    # jobs and ranked both grow with the table; what is made of a narrow column is taken for small and would be broadcast
    d = ranked.filter(F.col("rank") <= BULLETS).join(asked.hint("merge"), "job")
    has = F.filter("_asked", lambda t: F.contains(F.lower("text"), F.lower(t)))
    d = d.withColumn("_has", has)
    more = F.when(F.size("_has") > 0, _worded(NAMED, F.array_join("_has", ", "))).when(F.size("_asked") > 0, _worded(UNNAMED, F.array_join(F.slice("_asked", 1, SHOWN), ", ")))
    d = d.withColumn("suggested", F.concat("text", more)).filter("suggested IS NOT NULL")
    return d.select("job", "rank", F.lit("emphasize").alias("type"), F.col("id").alias("bullet_id"), F.col("text").alias("original"), "suggested", F.when(F.size("_has") > 0, SURE).otherwise(LESS_SURE).alias("confidence"), *others)


def validated(raw: DataFrame, bullets: DataFrame, evidence: DataFrame) -> DataFrame:
    """raw (job, pos, type, bullet_id, original, suggested, evidence_id, confidence) that may be shown, with the text of the
    stored bullet as original. If one suggestion of a posting has not the form of one, none of that posting counts; of
    the others those go whose bullet or evidence is not the posting's, and emphases that change nothing. bullets: job, id, text;
    evidence: job, id."""
    d = raw.withColumns({"type": F.coalesce("type", F.lit(TYPES[0])), "confidence": F.coalesce("confidence", F.lit(0.5))})
    formed = F.col("type").isin(TYPES) & F.col("bullet_id").rlike(UUID) & (F.length("original") > 0) & (F.length("suggested") > 0) & F.col("confidence").between(0, 1) & (F.col("evidence_id").isNull() | F.col("evidence_id").rlike(UUID))
    d = d.withColumn("_formed", F.coalesce(formed, F.lit(False)))
    broken = d.filter(~F.col("_formed")).select("job").distinct()
    b = bullets.dropDuplicates(["job", "id"]).select("job", F.col("id").alias("bullet_id"), F.col("text").alias("_text"))
    e = evidence.select("job", F.col("id").alias("evidence_id"), F.lit(True).alias("_known")).distinct()
    d = d.join(broken, "job", "left_anti").join(b, ["job", "bullet_id"]).join(e, ["job", "evidence_id"], "left")
    known = F.col("evidence_id").isNull() | F.col("_known")
    same = (F.col("type") == "emphasize") & (trim_blank(F.col("suggested")) == trim_blank(F.col("_text")))
    d = d.filter(F.coalesce(known, F.lit(False)) & ~same & (trim_blank(F.col("suggested")) != "") & (F.col("_text") != ""))
    return d.select("job", "pos", "type", "bullet_id", F.col("_text").alias("original"), "suggested", "evidence_id", "confidence")


def _blocks(d: DataFrame, keys: list[str], columns: list[str], order: str, n: int, name: str) -> DataFrame:
    """The rows of each key in arrays of n at most, numbered by _<name>."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    for k in keys:  # null is equal to nothing
        d = d.filter(F.col(k).isNotNull())
    d = d.withColumn(f"_{name}", F.floor(nth / n))
    return d.groupBy(*keys, f"_{name}").agg(F.collect_list(F.struct(*columns)).alias(name))


def _crossed(texts: DataFrame, evidence: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """texts (keys, job) joined with evidence on its keys. All jobs of a key meet all its evidence, so the result grows with their
    product: blocks of both are paired, and dealt as pairs, of far fewer bytes than their rows. The rows of a pair are
    then made in the order of its jobs, each with the same run of evidence, and a task has few jobs and keys: so in a columnar
    file a run of a job is one entry, and each run of evidence after the first of a page is a reference to it."""
    others = [c for c in evidence.columns if c not in (*keys, "job")]
    jobs = _blocks(texts, keys, ["job"], "job", JOBS, "jobs")
    said = _blocks(evidence, keys, others, "id", EVIDENCE, "said")
    d = jobs.join(said.hint("merge"), keys).repartition(tasks, *keys, "_jobs").sortWithinPartitions(*keys, "_jobs", "_said")
    # transform() keeps the jobs out of the generated code, which would hold all rows of a pair at once; so it holds those of one job
    d = d.select(*keys, "said", F.explode(F.transform("jobs", lambda j: j["job"])).alias("job"))
    return d.select(*keys, "job", F.inline("said"))


def linked_evidence(evidence: DataFrame, bullets: DataFrame, owner: str = "job") -> DataFrame:
    """The evidence (owner, id, source_id, text) of a posting's bullets (job, owner, id, text): that made from one of them, or
    that says the same, once for each job. owner: the job, or a column for whom its evidence is, so that a candidate's evidence
    meets only the bullets it fits and not each of their jobs. Joins on equal keys; a join on either would compare all pairs.
    bullets are read several times and counted."""
    of = list(dict.fromkeys(["job", owner]))
    texts = bullets.select(*of, "text").distinct()
    # bullets, texts and evidence all grow with the tables, so none is broadcast
    by_id = bullets.select(*of, F.col("id").alias("source_id")).distinct().join(evidence.hint("merge"), [owner, "source_id"]).join(texts.hint("merge"), [*of, "text"], "left_anti")
    if owner == "job":
        by_text = texts.join(evidence.hint("merge"), [owner, "text"])
    else:
        tasks = max(4 * bullets.sparkSession.sparkContext.defaultParallelism, -(-bullets.count() // JOBS_A_TASK))
        by_text = _crossed(texts, evidence, [owner, "text"], tasks)
    columns = ["job", *(c for c in evidence.columns if c != "job")]
    return by_id.select(*columns).unionByName(by_text.select(*columns))
