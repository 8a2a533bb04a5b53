"""Pasted text, slug lists and resume files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import trim_blank


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-blank line, trimmed, with its place among all lines."""
    d = docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
    return d.withColumn("line", trim_blank(F.col("line"))).filter("line <> ''")


def slug_list(payload: Column) -> Column:
    """The slugs of a JSON text that is an array or an object with `slugs`."""
    listed = F.from_json(payload, "array<string>")
    return F.coalesce(F.when(trim_blank(payload).startswith("["), listed), F.from_json(payload, "struct<slugs:array<string>>")["slugs"], F.array().cast("array<string>"))


def is_manual_text(text: Column) -> Column:
    """Pasted text, as opposed to an address or a JSON record."""
    t = trim_blank(text)
    return ~t.rlike(r"(?i)^https?://") & ~t.startswith("{") & (F.length(t) > 0)


def file_type(content: Column) -> Column:
    """pdf or docx by their first bytes, text if the first 512 bytes hold no control characters, else unknown."""
    head = F.hex(F.substring(content, 1, 512))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B"), "docx").when(~head.rlike(r"^(?:..)*?0[0-8EF]|^(?:..)*?1[0-9A-F]"), "text").otherwise("unknown")


def file_warnings(name: Column, size: Column, kind: Column) -> Column:
    """What is wrong with an uploaded file: empty, too_large (over 5 MB), unsupported, extension_mismatch."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    fits = F.when(kind == "text", ext.isin("txt", "md")).otherwise(ext == kind)
    return F.filter(
        F.array(F.when(size <= 0, "empty"), F.when(size > 5 * 1024 * 1024, "too_large"), F.when(kind == "unknown", "unsupported"), F.when((kind != "unknown") & (ext != "") & ~fits, "extension_mismatch")),
        lambda x: x.isNotNull(),
    )


CANDIDATE = "struct<companyName:string,atsProvider:string,boardSlug:string,boardUrl:string,companyWebsite:string,careersUrl:string,headquartersCountry:string,country:string,industries:array<string>,tags:array<string>,discoverySource:string,discoveryNote:string>"


def candidates(payload: Column, file: Column, seed: bool = False) -> Column:
    """The board candidates of a JSON text as an array of structs. An import is an array or an object with `candidates`,
    of which those with an address or a slug count, and names its file where it names no source; a seed is an object with
    `companies`, whose older fields `country` and `tags` stand in for the newer ones."""
    listed = F.from_json(payload, f"array<{CANDIDATE}>")
    inside = F.from_json(payload, f"struct<candidates:array<{CANDIDATE}>,companies:array<{CANDIDATE}>>")
    found = inside["companies"] if seed else F.when(trim_blank(payload).startswith("["), listed).otherwise(inside["candidates"])
    if not seed:
        found = F.filter(found, lambda c: (F.coalesce(c["boardUrl"], F.lit("")) != "") | (F.coalesce(c["boardSlug"], F.lit("")) != ""))
    source = lambda c: F.lit("existing-seed") if seed else F.coalesce(c["discoverySource"], F.concat(F.lit("import:"), file))
    older = lambda c, new, old: F.coalesce(c[new], c[old]) if seed else c[new]
    return F.transform(
        F.coalesce(found, F.array().cast(f"array<{CANDIDATE}>")),
        lambda c: F.struct(c["companyName"].alias("name"), c["atsProvider"].alias("provider"), c["boardSlug"].alias("slug"), c["boardUrl"].alias("url"), older(c, "headquartersCountry", "country").alias("country"), older(c, "industries", "tags").alias("industries"), source(c).alias("source")),
    )


def with_fallback(stored: DataFrame, bundled: DataFrame) -> DataFrame:
    """The stored catalog if it has rows, else the bundled one."""
    return bundled if stored.isEmpty() else stored
