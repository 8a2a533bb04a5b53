"""Text columns: trimming, HTML to plain text, entities, titles and small repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web pages use it; Java's \s has the ASCII ones only.
BLANK = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# What each tag becomes, in this order, and the named entities that are known.
TAG_TEXT = [
    (r"(?i)<script[^>]*>[\s\S]*?</script>", ""),
    (r"(?i)<style[^>]*>[\s\S]*?</style>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</p>", "\n\n"),
    (r"(?i)</div>", "\n"),
    (r"(?i)</li>", "\n"),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)<li[^>]*>", "• "),
    (r"<[^>]+>", ""),
]
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
LAYOUT = [(r"\r\n", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]
TITLE_MOST = 120


def word(pattern: str, flags: str = "i") -> str:
    r"""The pattern between word edges. ASCII edges: Java's \b counts accented letters as word characters."""
    return rf"(?{flags})(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def any_of(col: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (col.rlike(p) for p in patterns))


def replace_all(col: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, col)


def once(col: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(col), f), 0)


def trim_blank(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+\z", "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _character(code: Column, token: Column) -> Column:
    """The character of a code point; the token itself where there is none."""
    known = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(token)


def _decoded(token: Column) -> Column:
    name = F.lower(F.regexp_extract(token, r"^&(\w+);$", 1))
    number = F.regexp_extract(token, r"^&#([0-9]{1,9})", 1)
    hexa = F.regexp_extract(token, r"^&#x([0-9a-fA-F]{1,8});$", 1)
    named = reduce(lambda c, kv: c.when(name == kv[0], F.lit(kv[1])), list(NAMED_ENTITIES.items())[1:], F.when(name == "amp", F.lit("&")))
    return (
        F.when(~(token.startswith("&") & token.endswith(";") & (F.length(token) > 2)), token)
        .when(hexa != "", _character(F.conv(hexa, 16, 10).cast("long"), token))
        .when(token.startswith("&#x"), token)
        .when(number != "", _character(number.try_cast("long"), token))
        .otherwise(F.coalesce(named, token))
    )


def decode_entities(col: Column) -> Column:
    """Decimal, hexadecimal and six named entities, in one pass: what a decoded entity yields is not decoded again."""

    def decoded(c: Column) -> Column:
        tokens = F.regexp_extract_all(c, F.lit(r"&(?:#x?[0-9a-fA-F]+|\w+);|[^&]+|&"), F.lit(0))
        return F.when(c.contains("&"), F.array_join(F.transform(tokens, _decoded), "")).otherwise(c)

    return once(col, decoded)


def html_to_text(col: Column) -> Column:
    return trim_blank(replace_all(decode_entities(replace_all(col, TAG_TEXT)), LAYOUT))


def html_title(col: Column) -> Column:
    """og:title, else the title tag up to the first bar or dash, else the first h1; null where none fits."""
    og = blank_to_null(F.regexp_extract(col, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1))
    tag = blank_to_null(F.regexp_extract(col, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))
    head = trim_blank(F.split(decode_entities(trim_blank(tag)), r"\s*[|\-–—]\s*")[0])
    h1 = html_to_text(blank_to_null(F.regexp_extract(col, r"(?i)<h1[^>]*>([\s\S]*?)</h1>", 1)))
    short = lambda c: once(c, lambda x: F.when(F.length(x) <= TITLE_MOST, x))
    return F.coalesce(decode_entities(trim_blank(og)), blank_to_null(short(head)), short(h1))


def clean_title(col: Column, fallback: str = "Untitled Role") -> Column:
    t = decode_entities(trim_blank(F.regexp_replace(col, rf"{BLANK}+", " ")))
    return once(t, lambda x: F.when((F.length(x) > 0) & (F.length(x) <= TITLE_MOST), x).otherwise(F.lit(fallback)))


def format_description(col: Column) -> Column:
    marked = col.rlike(r"<[^>]+>") | col.rlike(r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|\w+);")
    return F.when(marked, html_to_text(col)).otherwise(trim_blank(decode_entities(col)))


def display_title(title: Column, description: Column) -> Column:
    """The title, else the first line of the description that could be one."""
    lines = F.transform(F.split(format_description(description), "\n"), trim_blank)
    first = F.get(F.filter(lines, lambda x: F.length(x).between(8, TITLE_MOST)), 0)
    return F.coalesce(blank_to_null(clean_title(title, "")), clean_title(first))


def slice_text(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def normalize_unicode(col: Column) -> Column:
    """Typographic blanks, dashes, quotes and ligatures to plain ones."""
    plain = F.translate(col, "\u00a0\u2013\u2014\u2212\u2018\u2019\u201c\u201d", " ---''\"\"")
    return F.replace(F.replace(plain, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def collapse_blanks(col: Column) -> Column:
    return trim_blank(F.regexp_replace(col, r"[ \t]+", " "))


def repair_hyphens(col: Column) -> Column:
    return F.regexp_replace(col, r"(\w)-\s*\n\s*(\w)", "$1-$2")


def tokens(col: Column) -> Column:
    """Distinct words over two letters, lower case, in order."""
    parts = F.split(F.regexp_replace(F.lower(col), r"[^\w\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 2))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the tokens of a that b has too; 1 where a has none."""
    have, n = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(tokens(a))
    return F.when(n == 0, F.lit(1.0)).otherwise(have / n)


def comma_list(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, ","), trim_blank), lambda x: F.length(x) > 0)


def format_salary(low: Column, high: Column, currency: Column) -> Column:
    """Amounts as text; 0 counts as missing."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    lo, hi = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    unit = F.coalesce(currency, F.lit("CAD"))
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(money(lo), F.lit(" – "), money(hi), F.lit(" "), unit))
        .when(lo.isNotNull(), F.concat(money(lo), F.lit("+ "), unit))
        .when(hi.isNotNull(), F.concat(F.lit("Up to "), money(hi), F.lit(" "), unit))
    )


def round_tenth(col: Column) -> Column:
    """To one decimal, halves upward."""
    return F.floor(col * 10 + 0.5) / 10


def round_share(col: Column) -> Column:
    """Clamped to 0..1, two decimals, halves upward."""
    return F.floor(F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5) / 100
