"""Resume files to parsed versions: ingest, the completion of parses, and answers of applications, each published as one version
of its tables, for the files of many users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.resume_lines import clean_lines
from hirelake.operators import resume
from hirelake.operators.approval import PARSED
from hirelake.operators.parse_cache import ParseCache
from hirelake.operators.profile import row_id
from hirelake.sources.shared import stored
from hirelake.sources.text import file_type, file_warnings, text_lines
from hirelake.sources.versions import Change, Versions

VERSIONS = PARSED + ", extraction_id string, hash string, parser_version string, parsed string, from_cache boolean"
ANSWERS = "application_id string, question string, answer string, evidence_ids array<string>, claims array<string>, updated string"


def normalized_text(text: Column) -> Column:
    """The lines of a text after repair, without blank ones."""
    lines = F.flatten(F.transform(F.split(text, r"\r?\n"), clean_lines))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def checked_files(files: DataFrame) -> DataFrame:
    """files (user_id, file_name, content) with kind, warnings and error: what is empty, too large or of no known kind is not
    taken, nor are PDF and DOCX, whose layout is not read here."""
    kind = file_type(F.col("content"))
    d = files.withColumn("kind", kind).withColumn("warnings", file_warnings(F.col("file_name"), F.length("content"), F.col("kind")))
    grave = F.get(F.filter("warnings", lambda w: w.isin("empty", "too_large", "unsupported")), 0)
    return d.withColumn("error", F.coalesce(grave, F.when(F.col("kind") != "text", "layout_not_read")))


def ingest(store: Versions, cache: ParseCache, files: DataFrame, parser_version: str, at: str) -> int:
    """Publishes documents, resume_versions, extractions and parsed_versions of all files that can be taken. A text that the user
    has had parsed by this version of the parser is ready for review at once; others are processing."""
    spark = files.sparkSession
    d = checked_files(files).filter("error IS NULL").withColumn("text", normalized_text(F.decode("content", "UTF-8")))
    d = d.withColumns({"hash": F.sha2("text", 256), "document_id": row_id(F.col("user_id"), F.col("file_name"), F.sha2("content", 256), F.lit(at))})
    d = d.dropDuplicates(["document_id"]).withColumns({"extraction_id": row_id(F.col("document_id"), F.lit("extraction")), "version_id": row_id(F.col("document_id"), F.lit("parsed"))})
    known = cache.look_up(d.withColumn("user", F.col("user_id")), parser_version)
    d = stored(spark, known, "ingested")
    hit, at_ = F.col("parsed").isNotNull(), F.lit(at)
    tables = {
        "documents": ("document_id", d.select("document_id", "user_id", "file_name", F.length("content").cast("long").alias("size"), "warnings", F.col("text").alias("extracted_text"), F.col("extraction_id").alias("latest_extraction_id"), at_.alias("created"))),
        "resume_versions": ("document_id", d.select("document_id", "user_id", F.lit("Master Resume").alias("name"), F.lit("master").alias("version_type"), F.col("text").alias("content_text"))),
        "extractions": ("extraction_id", d.select("extraction_id", "document_id", "user_id", F.col("text").alias("normalized_text"), "hash", at_.alias("created"))),
        "parsed_versions": ("version_id", d.select("version_id", "user_id", row_id(F.col("user_id"), F.lit("profile")).alias("profile_id"), F.when(hit, "pending_review").otherwise("processing").alias("status"), F.lit(None).cast("string").alias("approved_at"), "extraction_id", "hash", F.lit(parser_version).alias("parser_version"), "parsed", hit.alias("from_cache"))),
    }
    return store.change(lambda base: [store.add(name, rows, F.col(key)) for name, (key, rows) in tables.items()])


def parse(extractions: DataFrame) -> DataFrame:
    """extraction_id and parsed (JSON) of texts (extraction_id, normalized_text); null where a text has no line."""
    lines = text_lines(extractions, "extraction_id", "normalized_text").select(F.col("extraction_id").alias("doc"), F.col("line_no"), F.col("line").alias("text"))
    found = resume.parsed(lines)
    return extractions.select("extraction_id").join(found.select(F.col("doc").alias("extraction_id"), F.to_json(F.struct(*[c for c in found.columns if c != "doc"])).alias("parsed")), "extraction_id", "left")


def complete(store: Versions, cache: ParseCache, at: str) -> int:
    """Parses what is processing: versions become ready for review, or failed if their text has no line. Each parse is logged in
    parse_runs; the cache learns what was parsed after the version is published, so it never holds what nobody has."""
    spark, done = store.spark, []

    def changes(base: int) -> list[Change]:
        open_ = stored(spark, store.read("parsed_versions", base, schema=VERSIONS).filter("status = 'processing'"), "open")
        texts = store.read("extractions", base, schema="extraction_id string, normalized_text string").select("extraction_id", "normalized_text").join(open_.select("extraction_id"), "extraction_id", "left_semi")
        found = open_.drop("parsed").join(parse(texts), "extraction_id")
        found = stored(spark, found.withColumn("status", F.when(F.col("parsed").isNotNull(), "pending_review").otherwise("failed")), "parsed")
        done[:] = [found]
        key = F.col("version_id")
        ranges = store.ranges_of(found, key)
        now = store.read("parsed_versions", base, ranges, VERSIONS)
        rest = now.join(found.select("version_id"), "version_id", "left_anti").select(*now.columns)
        runs = found.select("version_id", "user_id", F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("status"), F.lit(at).alias("finished"))
        return [store.write("parsed_versions", rest.unionByName(found.select(*now.columns)), key, ranges), store.add("parse_runs", runs, key)]

    version = store.change(changes)
    good = done[0].filter("status = 'pending_review'")
    cache.add(good.select(F.col("user_id").alias("user"), "hash", F.col("parser_version").alias("version"), F.unix_micros(F.lit(at).cast("timestamp")).alias("created"), "parsed"))
    return version


def save_answers(store: Versions, answers: DataFrame, at: str) -> int:
    """Publishes answers (application_id, question, answer and, nullable, evidence_ids and claims): an answer to a question that was
    answered before replaces it, and keeps its evidence and claims where none are given."""
    key = F.concat_ws("|", "application_id", "question")
    new = stored(store.spark, answers.dropDuplicates(["application_id", "question"]), "answers")
    ranges = store.ranges_of(new, key)

    def changes(base: int) -> list[Change]:
        old = store.read("answers", base, ranges, ANSWERS).alias("o")
        d = new.alias("n").join(old, (F.col("n.application_id") == F.col("o.application_id")) & (F.col("n.question") == F.col("o.question")), "full")
        given, none = F.col("n.application_id").isNotNull(), F.array().cast("array<string>")
        both = lambda c: F.coalesce(f"n.{c}", f"o.{c}")
        rows = d.select(both("application_id").alias("application_id"), both("question").alias("question"), F.when(given, F.col("n.answer")).otherwise(F.col("o.answer")).alias("answer"), F.coalesce(both("evidence_ids"), none).alias("evidence_ids"), F.coalesce(both("claims"), none).alias("claims"), F.when(given, F.lit(at)).otherwise(F.col("o.updated")).alias("updated"))
        return [store.write("answers", rows, key, ranges)]

    return store.change(changes)

