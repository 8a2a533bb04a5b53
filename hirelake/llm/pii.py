"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, EM estimates
for each kind how reliable each labeler is, and the posteriors train the final span classifier.

The four base kinds (email, ip, card, phone) are exact patterns: their valid matches are always spans. Candidates
that the base rules leave out become spans if the classifier says so and no base span overlaps them: national phone
numbers, social security numbers, addresses with (at) and (dot), names of two capitalised words, and secrets (runs of
16 letters and digits or more, such as keys and tokens). None of them has a greatest length.

The classifier sees what the labelers don't: length, kinds and number of characters, and what stands before a span.
Vote patterns, and cells of features, are tables of bounded size, so all fits use exact counts of all candidates:
3 ** 6 patterns a kind for EM, and 4 ** 4 * 3 ** 3 cells a kind for the classifier. A kind with few candidates leans on the
reliabilities of all kinds together.

Positions are code points, end exclusive. Null texts count as empty; rows are judged alone. A text with n matches takes
time as n log n: places are prefix sums of the lengths of matches and of what lies between, overlaps with base spans a
running maximum over sorted ends, and what stands around a span is taken from the block of BLOCK characters it is in.

Java's regex engine recurses once for each repeat of a group, so long texts could overflow its stack.
The patterns here have no repeated groups: separators that continue a match are first marked, one
character for one, and a match is then a run of one character class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm import weak
from hirelake.llm.common import materialise

BASE = ("email", "ip", "card", "phone")
MORE = ("ssn", "local_phone", "spelled_email", "name", "secret")
KINDS = BASE + MORE
VOTERS = ("v_format", "v_gazetteer", "v_context", "v_edges", "v_shape", "v_place")
FEATURES = ("f_length", "f_classes", "f_distinct", "f_before")
ADD_FROM = 0.5
CONTEXT = 40  # code points looked at before a span
BLOCK = 1_024
MARK, OTHER = "\uf8ff", "\ufffd"  # MARK stands for a separator inside a match; where a text has it, OTHER takes its place

# Word lists and number plans of the labelers.
TOP_DOMAINS = "ae ai app ar at au be bg biz br ca cat ch cl cn co com cz de dev dk edu ee es eu fi fr gov gr hk hr hu id ie il in info int io is it jp ke kr lt lu lv ma me mil mx my name net ng nl no nz online org pe ph pk pl pro pt ro rs ru sa se sg shop si site sk tech th tr tv tw ua uk us uy ve vn xyz za".split()
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-4][0-9]|25[0-8]|26[0-9]|29[01789]|35[0-9]|37[0-9]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-35-9]|69[0-2]|85[02356]|8[78]0|886|96[0-8]|97[0-79]|99[2-68])"
RESERVED_IP = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CARD_ISSUER = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62|50|5[6-9])"
GIVEN_NAMES = "Aaron Adam Ahmed Alan Alejandro Alexander Alexandra Alice Amanda Amelia Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Barbara Beatrice Benjamin Brian Carlos Carmen Caroline Catherine Charles Charlotte Christian Christina Christine Claire Claudia Daniel David Deborah Diana Diego Dmitri Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Fatima Fernando Francisco Frank Friedrich Gabriel Gabriela George Giulia Grace Hannah Hans Harold Heather Helen Henry Hiroshi Ibrahim Isabella Ivan Jacob James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Joan Johannes John Jonathan Jose Joseph Joshua Juan Julia Julian Karen Katharina Kenneth Kevin Klaus Laura Lauren Linda Lisa Lorenzo Louis Lucas Luis Manuel Marco Margaret Maria Marie Mark Martha Martin Mary Matthew Matthias Melissa Michael Michelle Miguel Mohammed Monica Nancy Nathan Nicholas Nicole Olga Oliver Olivia Pablo Patricia Patrick Paul Pedro Peter Philip Philippe Pierre Priya Rachel Rafael Raymond Rebecca Richard Robert Roberto Ronald Rosa Ruth Ryan Samantha Samuel Sandra Sarah Scott Sebastian Sergei Sharon Sofia Sophie Stephanie Stephen Steven Susan Teresa Theresa Thomas Timothy Valentina Victoria Vincent Walter Wei William Wolfgang Yuki Yusuf".split()
NOT_NAMES = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday North South East West New United The This That These Those And But For With From Dear Chapter Section Figure Table Part Page Street Road Avenue Inc Ltd Corp University Institute License Public General Version Copyright".split()
NAME_TITLE = r"(?i)(?:^|[^\p{L}])(?:mr|mrs|ms|dr|prof|sir|name|signed|sincerely|regards|contact|author|by|from|attn)\.?\W*$"
SURNAME = r"(?:son|sen|ez|ski|sky|mann|berg|stein|ini|etti|ova|ov|ier|eau|escu|poulos|yan|oglu|wicz|ford|ton|ley|er)$"
KEY_PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abp]-|AIza|eyJ|ya29)"
GOOD_CONTEXT = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|ip|host|address|name|mr|mrs|ms|dr|ssn|social security|signed|from|to|token|secret|password|passwd|pwd|api.?key|access.?key|bearer|credential|auth)\W*(?:no|number|nr|is|at)?\W*$"
BAD_CONTEXT = r"(?i)(?:version|release|isbn|issn|order|sku|part|page|section|figure|build|commit|sha1|sha256|md5|digest|checksum|etag|revision)\W*(?:no|number|nr)?\W*$"

LOCAL = r"A-Za-z0-9._%+\-" + MARK
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\-{MARK}]*+"
EMAIL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]++"
CARD_GAP = r"(?<=[0-9])[\x20-](?=[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SPELLED_EMAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}+"
# two capitalised words; where the second is a given name before another such word, the name starts there
NAME = r"(?<![\p{L}\p{N}_])[A-Z][a-z]++\x20(?!(?:" + "|".join(GIVEN_NAMES) + r")\x20[A-Z][a-z])[A-Z][a-z]++(?![\p{L}\p{N}_])"
SECRET = r"(?<![\p{L}\p{N}_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+(?![\p{L}\p{N}_+/=@-])"


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, both) -> Column:
    """What `both` makes of each value and all before it, in as many rounds as the length has bits: round k takes in what is
    2 ** k places before. 0 must change nothing."""

    def round_(done: Column, step: Column) -> Column:
        earlier = F.slice(F.concat(F.transform(F.sequence(F.lit(1), step), lambda _: F.lit(0)), done), F.lit(1), F.size(done))
        return F.when(step < F.size(done), F.zip_with(done, earlier, both)).otherwise(done)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(31))), values, round_)


def _found(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches as structs of kind, start, end and value."""
    value, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def placed(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["value"])), lambda a, b: a + b)
        of_kind = F.lit(KINDS.index(kind)).alias("kind")
        return F.zip_with(parts, ends, lambda x, end: F.struct(of_kind, (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value")))

    parts = F.zip_with(gap, value, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(guard, _let(F.filter(parts, lambda x: x["value"].isNotNull()), placed)).otherwise(none)


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of `base`. By ends of spans and starts of base spans in one order: a span is apart if no
    base span that starts before its end ends after its start."""
    event = lambda x, at, ends, i: F.struct(x[at].alias("at"), ends.alias("ends"), i.alias("i"))
    queries = F.transform(spans, lambda x, i: event(x, "end", F.lit(0), i))  # before a base span that starts there
    events = F.sort_array(F.concat(queries, F.transform(base, lambda x: event(x, "start", x["end"], F.lit(-1)))))

    def apart(events: Column) -> Column:
        reached = _running(F.transform(events, lambda e: e["ends"]), lambda a, b: F.greatest(a, b))
        asked = F.filter(F.zip_with(events, reached, lambda e, r: F.struct(e["i"].alias("i"), r.alias("reached"))), lambda e: e["i"] >= 0)
        free = F.transform(F.sort_array(asked), lambda e: e["reached"])
        both = F.zip_with(spans, free, lambda x, r: F.struct(x.alias("span"), r.alias("reached")))
        return F.transform(F.filter(both, lambda y: y["reached"] <= y["span"]["start"]), lambda y: y["span"])

    return F.when((F.size(base) > 0) & (F.size(spans) > 0), _let(events, apart)).otherwise(spans)


def _around(x: Column, blocks: Column) -> Column:
    """The CONTEXT characters before a span and the one after it, as a struct of before, left and right."""
    at = lambda n: F.coalesce(F.get(blocks, n), F.lit(""))

    def cut(start: Column, length: Column) -> Column:
        number = F.floor(start / BLOCK).cast("int")
        return F.substring(F.concat(at(number), at(number + 1)), start - number * BLOCK + 1, length)

    from_ = F.greatest(x["start"] - CONTEXT, F.lit(0))
    return F.struct(cut(from_, x["start"] - from_).alias("before"), cut(F.greatest(x["start"] - 1, F.lit(0)), F.least(x["start"], F.lit(1))).alias("left"), cut(x["end"], F.lit(1)).alias("right"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(_twice(F.try_to_number(c, F.lit("9")).cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _twice(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _is(x: Column, kind: str) -> Column:
    return x["kind"] == KINDS.index(kind)


def _valid(x: Column) -> Column:
    """Whether a match passes the rules of its kind."""
    digits = _digits(x["value"])
    n = F.length(digits)
    small = F.forall(F.split(x["value"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    ssn = ~digits.rlike(r"^(?:000|666|9)|^[0-9]{3}00|0000$")
    national = digits.rlike(r"^[2-9][0-9]{2}[2-9]")
    return (
        F.when(_is(x, "ip"), small)
        .when(_is(x, "card"), n.between(12, 19) & _luhn(digits))
        .when(_is(x, "phone"), n.between(9, 15))
        .when(_is(x, "ssn"), ssn)
        .when(_is(x, "local_phone"), national)
        .when(_is(x, "spelled_email"), x["value"].rlike(r"[A-Za-z][A-Za-z0-9._-]*+\x20?[\[(]at"))
        .when(_is(x, "name"), ~x["value"].rlike(r"(?:^|\x20)(?:" + "|".join(NOT_NAMES) + r")(?:\x20|$)"))
        .when(_is(x, "secret"), ~x["value"].rlike(r"^[A-Za-z]+[0-9]{1,4}$|^[0-9]{1,4}[A-Za-z]+$|[-_/+=]{2}|^[-/_+=]|-[A-Za-z]+-[A-Za-z]+|/[a-z-]{3,}(?:/|$)"))
        .otherwise(F.lit(True))
    )


def _distinct(x: Column) -> Column:
    return F.size(F.array_distinct(F.split(x, "")))


def _votes(x: Column, near: Column) -> dict[str, Column]:
    value, digits = x["value"], _digits(x["value"])
    before, around = near["before"], [near["left"], near["right"]]
    top = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    both = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    mail, long_number = _is(x, "email") | _is(x, "spelled_email"), _is(x, "card") | _is(x, "phone") | _is(x, "local_phone") | _is(x, "ssn")
    code, reserved, issuer = digits.rlike(CALLING_CODE), value.rlike(RESERVED_IP), digits.rlike(CARD_ISSUER)
    given, sure_key = F.substring_index(value, " ", 1).isin(GIVEN_NAMES), value.rlike(KEY_PREFIX)
    digest = value.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40})$")
    path = around[0].isin("/", "\\") | around[1].isin("/", "\\")
    assigned, quoted = before.rlike(r"[:=]\s*[\x22'`]?$"), around[0].isin('"', "'", "`", "(", "<", "[")
    return {
        # what the wording before a look-alike calls something else has no valid form either
        "v_format": both(x["valid"], ~x["valid"] | (before.rlike(BAD_CONTEXT) & (x["kind"] >= len(BASE)))),
        "v_gazetteer": F.when(mail, both(top.isin(TOP_DOMAINS), F.length(top) < 2))
        .when(_is(x, "ip"), both(~reserved, reserved))
        .when(_is(x, "card"), both(issuer, ~issuer))
        .when(_is(x, "phone"), both(code, ~code))
        .when(_is(x, "local_phone"), both(F.lit(False), digits.rlike("^[2-9]11|^[0-9]{3}[2-9]11")))
        .when(_is(x, "ssn"), both(F.lit(False), digits.isin("123456789", "078051120", "219099999")))
        .when(_is(x, "name"), both(given, ~given & ~value.rlike(SURNAME)))
        .otherwise(both(sure_key | digest, F.lit(False))),
        "v_context": both(before.rlike(GOOD_CONTEXT), before.rlike(BAD_CONTEXT)),
        "v_edges": both(F.lit(False), around[0].rlike(r"[\p{L}\p{N}_]") & (x["start"] > 0) | around[1].rlike(r"[\p{L}\p{N}_]")),
        "v_shape": F.when(long_number, both(F.lit(False), _distinct(digits) <= 2))
        .when(_is(x, "secret"), both((_distinct(value) >= 10) & value.rlike("[0-9][A-Za-z]+[0-9]"), _distinct(value) <= 6))
        .when(_is(x, "name"), both(F.lit(False), before.rlike(r"(?:^|[.!?:\n])\s*[\x22'(]?$") & ~given))
        .otherwise(both(F.lit(False), F.length(value) > 254)),
        "v_place": F.when(_is(x, "secret"), both(assigned, path | ~assigned & ~quoted & ~sure_key))
        .when(_is(x, "name"), both(before.rlike(NAME_TITLE), path))
        .otherwise(both(assigned | quoted, path)),
    }


def _features(x: Column, near: Column) -> dict[str, Column]:
    """What a span looks like, in four classes each."""
    value, before = x["value"], near["left"]
    step = lambda c, *edges: F.coalesce(*(F.when(c < e, i) for i, e in enumerate(edges)), F.lit(len(edges)))
    classes = [F.when(value.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    return {
        "f_length": step(F.length(value), 12, 20, 36),
        "f_classes": classes[0] + classes[1] + classes[2] + classes[3] - 1,
        "f_distinct": step(_distinct(value), 6, 9, 13),
        "f_before": F.when(x["start"] == 0, 0).when(before.isin("\n", "\t"), 0).when(before.isin('"', "'", "`", "=", ":"), 1).when(before == " ", 2).otherwise(3),
    }


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_candidates`: kind, start, end, valid, votes and features of every candidate span of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_digit", F.col("_t").rlike("[0-9]"))
    col, digit = F.col("_t"), F.col("_digit")
    clean = lambda c: F.replace(c, F.lit(MARK), F.lit(OTHER))
    mail = col.contains("@")
    cards = digit & col.rlike(r"[0-9][0-9\x20-]{10}")
    d = d.withColumns({
        "_tm": F.when(mail, F.regexp_replace(clean(col), EMAIL_DOT, MARK)).otherwise(F.lit("")),
        "_tc": F.when(cards, F.regexp_replace(clean(col), CARD_GAP, MARK)).otherwise(F.lit("")),
    })
    d = d.withColumns({
        "_c0": _found(F.col("_tm"), EMAIL, "email", mail),
        "_c1": _found(col, IP, "ip", digit & col.rlike(r"[0-9]\.[0-9]")),
        "_c2": _found(F.col("_tc"), CARD, "card", cards),
        "_c3": _found(col, PHONE, "phone", digit & col.contains("+")),
        "_c4": _found(col, SSN, "ssn", digit & col.contains("-")),
        "_c5": _found(col, LOCAL_PHONE, "local_phone", digit),
        "_c6": _found(col, SPELLED_EMAIL, "spelled_email", col.rlike(r"[\[(]at[\])]")),
        "_c7": _found(col, NAME, "name", col.rlike(r"[A-Z][a-z]++\x20[A-Z][a-z]")),
        "_c8": _found(col, SECRET, "secret", digit & col.rlike(r"[A-Za-z0-9_+/=-]{16}")),
    })
    # the card chain of few digits is no candidate of anything
    few = F.filter("_c2", lambda x: F.length(_digits(x["value"])) >= 12)
    every = F.concat("_c0", "_c1", few, "_c3", "_c4", "_c5", "_c6", "_c7", "_c8")
    named = lambda x, v: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.replace(x["value"], F.lit(MARK), F.lit(".")).alias("value"), v.alias("valid"))
    d = d.withColumn("_every", F.transform(every, lambda x: named(x, _valid(x))))
    judged = lambda x, near: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["valid"].alias("valid"), *(v.cast("int").alias(k) for k, v in (_votes(x, near) | _features(x, near)).items()))
    blocks = F.regexp_extract_all(col, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    with_near = lambda blocks: F.transform("_every", lambda x: F.struct(x.alias("x"), _around(x, blocks).alias("near")))
    voted = F.transform(F.when(F.size("_every") > 0, _let(blocks, with_near)).otherwise(_let(F.array(F.lit("")), with_near)), lambda y: judged(y["x"], y["near"]))
    return d.withColumn("_candidates", voted).drop("_t", "_digit", "_tm", "_tc", *(f"_c{i}" for i in range(len(KINDS))), "_every")


@dataclass
class SpanClassifier:
    """Logistic regression over the kind of a span and, for each kind, the classes of its features."""

    bias: dict[int, float]
    weight: dict[tuple[int, int, int], float]  # kind, number of the feature, class

    def score(self, kind: int, features: tuple[int, ...]) -> float:
        z = self.bias[kind] + sum(self.weight.get((kind, j, v), 0.0) for j, v in enumerate(features))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def probability(self, kind: Column, features: list[Column]) -> Column:
        z = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in self.bias.items()), F.lit(0.0))
        for j, c in enumerate(features):
            table = F.create_map(*(F.lit(x) for (k, i, v), w in self.weight.items() if i == j for x in (k * 16 + v + 4, w))) if self.weight else F.create_map()
            z = z + F.coalesce(F.try_element_at(table, (kind * 16 + c + 4).cast("int")), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[int, weak.VoteModel]:
    """counts: kind, votes and number of all candidates. One model a kind, each leaning on that of all kinds together."""
    by_votes: dict[tuple[int, ...], int] = {}
    for _, votes, n in counts:
        by_votes[votes] = by_votes.get(votes, 0) + n
    both = weak.fit(sorted(by_votes.items()), len(VOTERS), prior=0.7)
    return {k: weak.fit(sorted((v, n) for kind, v, n in counts if kind == k), len(VOTERS), like=both) for k in range(len(KINDS))}


def train(cells: list[tuple[int, tuple[int, ...], int, float]], rounds: int = 300, rate: float = 4.0, decay: float = 1e-3) -> SpanClassifier:
    """cells: kind, features, number of candidates and the sum of their posteriors, which are the targets."""
    total: dict[int, int] = {}
    for kind, _, n, _ in cells:
        total[kind] = total.get(kind, 0) + n
    out = SpanClassifier(dict.fromkeys(range(len(KINDS)), 0.0), {(k, j, v): 0.0 for k, f, *_ in cells for j, v in enumerate(f)})
    for _ in range(rounds):
        bias, weight = dict.fromkeys(out.bias, 0.0), dict.fromkeys(out.weight, 0.0)
        for kind, features, n, good in cells:
            g = (good - n * out.score(kind, features)) / total[kind]
            bias[kind] += g
            for j, v in enumerate(features):
                weight[kind, j, v] += g
        for k in bias:
            out.bias[k] += rate * (bias[k] - decay * out.bias[k])
        for k in weight:
            out.weight[k] += rate * (weight[k] - decay * out.weight[k])
    return out


def find(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans, one row per row of `docs` (doc_id, text)."""
    d = materialise(candidates(docs.select("doc_id", "text")).drop("text"), "pii")
    each = d.select(F.explode("_candidates").alias("c")).select("c.*")
    rows = each.groupBy("kind", *VOTERS).count().collect()
    models = reliabilities(sorted((r["kind"], tuple(r[v] for v in VOTERS), r["count"]) for r in rows))
    posterior = F.coalesce(*(F.when(F.col("kind") == k, m.posterior([F.col(v) for v in VOTERS])) for k, m in models.items()))
    told = [*FEATURES, "v_context", "v_format", "v_place"]
    cells = each.groupBy("kind", *told).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(posterior * 1_000_000).cast("long")).alias("good")).collect()
    model = train(sorted((r["kind"], tuple(r[f] for f in told), r["n"], r["good"] / 1_000_000) for r in cells))
    base = F.filter("_candidates", lambda x: (x["kind"] < len(BASE)) & x["valid"])
    d = d.withColumn("_base", base)
    score = lambda x: model.probability(x["kind"], [x[f] for f in told])
    d = d.withColumn("_likely", F.filter("_candidates", lambda x: (x["kind"] >= len(BASE)) & (score(x) >= add_from)))
    d = d.withColumn("_added", _apart(F.col("_likely"), F.col("_base")))
    key = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda xs: F.array_join(F.transform(F.sort_array(F.transform(xs, key)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("_base", lambda x: _is(x, kind))).cast("long")
    return d.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(F.col("_base")), 256).alias("base_sha256"), text(F.concat("_base", "_added")).alias("spans"), F.size("_added").alias("n_added"), (F.size("_base") + F.size("_added")).cast("long").alias("n_spans"))
