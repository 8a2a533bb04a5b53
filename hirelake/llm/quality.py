"""Quality rules by weak supervision: each rule votes for, votes against or abstains; EM estimates how
reliable every rule is, and a document stays if its posterior quality probability is high enough.

Nulls and blank texts have no words and fail the base rule. Windows of 8 words are told apart by 64-bit hashes.
Rows are judged alone, so repeated rows and null ids get the same verdict as any other row. Columns of the input that share a name with a measure
are an error of the caller only for `measure`; `filter_documents` keeps the input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm import weak
from hirelake.llm.common import NOT_SPACE, materialise, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines")
RULES = ("v_length", "v_word_length", "v_symbols", "v_symbol_chars", "v_dup_lines", "v_repeats", "v_sentences", "v_line_length")
KEEP_FROM = 0.5


def _pairs(column: str, step: int, n: Column) -> Column:
    """Hashes of runs twice as long: position i joined with position i + step."""
    size = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), size), F.slice(column, F.lit(1 + step), size), lambda a, b: F.xxhash64(a, b))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of every whole text. n_repeat_words counts the words inside 8-word windows that the text has twice or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("_w", words(t)).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_SPACE)))
    # hashes of 1, 2, 4 and 8 consecutive words, each stage from the one before
    n = F.col("n_words").cast("int")
    d = d.withColumn("_h1", F.when(n >= WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_h2", _pairs("_h1", 1, n - 1)).withColumn("_h4", _pairs("_h2", 2, n - 3)).withColumn("_h8", F.when(n >= WINDOW, _pairs("_h4", 4, n - 7)).otherwise(F.col("_h1")))
    d = d.withColumn("_again", F.size(F.array_distinct("_h8")) < F.size("_h8"))
    order = F.when(F.col("_again"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_order", order)
    twice = F.filter(
        F.transform("_order", lambda x, j: F.when((x["h"] == F.get("_order", j - 1)["h"]) | (x["h"] == F.get("_order", j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("_at", F.sort_array(twice))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    d = d.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_ended_lines": F.size(F.filter("_lines", lambda line: line.rlike(r"[.!?:;\x22'…”)]\s*$"))).cast("long"),
        "n_repeat_words": F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long"),
    })
    return d.drop("_w", "_lines", "_h1", "_h2", "_h4", "_h8", "_again", "_order", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules. Each leaves a range between good and bad in which it abstains."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    dup, again = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n
    ended, per_line = F.col("n_ended_lines") / lines, F.col("n_words") / lines
    dense = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "v_length": _vote(F.col("n_words") >= 30, F.col("n_words") < 20),
        "v_word_length": _vote((mean >= 2.8) & (mean <= 11), (mean < 2) | (mean > 15)),
        "v_symbols": _vote(symbols <= 0.02, symbols > 0.08),
        "v_symbol_chars": _vote(dense <= 0.005, dense > 0.02),
        "v_dup_lines": _vote(dup <= 0.2, dup > 0.3),
        "v_repeats": _vote(again <= 0.2, again > 0.3),
        "v_sentences": _vote(ended >= 0.3, (ended < 0.1) & (F.col("n_lines") >= 3)),
        "v_line_length": _vote(per_line >= 3, per_line < 1.5),
    }


def judge(measured: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds base_failed, p_quality and kept. `measured` is read twice: write it out first."""
    voted = measured.withColumns(votes())
    model = weak.fit(weak.patterns(voted, list(RULES)), len(RULES))
    p = model.posterior([F.col(r) for r in RULES])
    failed = base_failed()
    return voted.withColumn("p_quality", p).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_quality") >= keep_from)).drop(*RULES)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id with measures, posterior and verdict of each row of `docs` (doc_id, text)."""
    return judge(materialise(measure(docs.select("doc_id", "text")).drop("text"), "quality"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`. Texts are written once beside their measures, so that they are measured once."""
    row = docs.select(F.struct("*").alias("_row"), F.col("text"))
    measured = materialise(measure(row).drop("text"), "quality-rows")
    return judge(measured).filter("kept").select("_row.*")
