"""Named queries over the driver tables, each with hand-written SQL that must give the same rows.

The tables hold no postings, so each query maps an operator onto a table of like shape: orders stand for postings,
customers for owners, suppliers for boards. match_catalog and posting_catalog work on texts derived from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions import signals, skills, text, urls
from hirelake.operators import dashboard, feed, incremental, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EPOCH = "1998-08-01 00:00:00"  # the point in time that queries about recent rows look back from


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text ------------------------------------------------------------------------------------------------------

_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<script[^>]*>[\s\S]*?</script>', '', 'gi'), '<style[^>]*>[\s\S]*?</style>', '', 'gi'), '<br\s*/?>', chr(10), 'gi'), '</p>', chr(10) || chr(10), 'gi'), '</div>', chr(10), 'gi'), '</li>', chr(10), 'gi'), '</h[1-6]>', chr(10) || chr(10), 'gi'), '<li[^>]*>', '• ', 'gi'), '<[^>]+>', '', 'g')"
_NAMED = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_LAYOUT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_PLAIN = _LAYOUT.format(x=_NAMED.format(x=_TAGS.format(x="html")))


@query(f"SELECT page_id, {_PLAIN} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(
    r"""WITH t AS (SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>([\s\S]*?)</title>', 1, 'i'), '') AS raw FROM pages),
    h AS (SELECT page_id, regexp_replace(string_split_regex("""
    + _NAMED.format(x=r"regexp_replace(raw, '^\s+|\s+$', '', 'g')")
    + r""", '\s*[|\-–—]\s*')[1], '^\s+|\s+$', '', 'g') AS head FROM t)
    SELECT page_id, CASE WHEN length(head) BETWEEN 1 AND 120 THEN head END AS title FROM h"""
)
def html_title(spark, sf_dir):
    # no page has og:title; where the title tag gives nothing, the first h1 may
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.slugify(F.col("s_name")).alias("slug"))


_HASH = r"substr(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 16)"


@query(f"SELECT {_HASH} AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", urls.description_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"SELECT key, n, doc_id AS member FROM (SELECT {_HASH} AS key, doc_id, count(*) OVER (PARTITION BY {_HASH}) AS n FROM documents) WHERE n > 1")
def duplicate_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", urls.description_hash(F.col("text")).alias("hash"))
    return registry.duplicate_rows(d, F.col("hash")).select("key", "n", F.col("doc_id").alias("member"))


@query(
    f"""WITH old AS (SELECT doc_id, {_HASH} AS old_hash FROM documents JOIN labels USING (doc_id)),
    new AS (SELECT d.doc_id, d.text || CASE WHEN l.toxic = 1 THEN ' (edited)' ELSE '' END AS text FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT new.doc_id, CASE WHEN old_hash IS NULL THEN 'insert' WHEN old_hash = {_HASH} THEN 'skip' ELSE 'update' END AS action
    FROM new LEFT JOIN old USING (doc_id)"""
)
def change_detect(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stored = docs.join(labels, "doc_id").select("doc_id", urls.description_hash(F.col("text")).alias("hash"))
    edited = F.concat("text", F.when(F.col("toxic") == 1, " (edited)").otherwise(""))
    return incremental.actions(stored, docs.join(labels, "doc_id", "left").select("doc_id", edited.alias("text")), "doc_id", "text").select("doc_id", "action")


@query(
    r"""WITH l AS (SELECT doc_id, source, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents),
    k AS (SELECT * FROM l WHERE line <> ''), many AS (SELECT source, line FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2)
    SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (many.line IS NULL) AS n_kept FROM k LEFT JOIN many USING (source, line) GROUP BY k.doc_id"""
)
def skip_repeated_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return incremental.kept_lines(docs)


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')) AS emails, len(regexp_extract_all(text, '\+?\d?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}')) AS phones FROM documents"""
)
def contact_extract(spark, sf_dir):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(r"[\w.+-]+@[\w-]+\.[\w.-]+").alias("emails"), count(r"\+?\d?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}").alias("phones"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_TOKENS.format(x="text")} AS now, {_TOKENS.format(x="lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS before FROM conversations)
    SELECT conv_id, turn, CASE WHEN before IS NULL THEN NULL WHEN len(now) = 0 THEN 1.0 ELSE floor(len(list_intersect(now, before)) / len(now) * 100 + 0.5) / 100 END AS overlap FROM t"""
)
def token_overlap(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w))
    return d.select("conv_id", "turn", F.when(F.col("before").isNotNull(), text.round_share(text.token_overlap(F.col("text"), F.col("before")))).alias("overlap"))


_OWN = ["steel", "copper", "brass", "tin", "nickel", "red", "blue", "green"]


@query(f"SELECT p_partkey, list_filter({_OWN}, lambda k: contains(lower(p_name || ' ' || p_type), k))::VARCHAR AS found FROM part")
def keyword_extract(spark, sf_dir):
    found = skills.technologies(F.concat_ws(" ", "p_name", "p_type"), _OWN)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("found"))


# ---- feed ------------------------------------------------------------------------------------------------------


def _jobs(spark, sf_dir):
    """Orders as postings."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return d.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("n_name").alias("location"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("discovered"), F.col("o_totalprice").alias("salary_max"), F.col("o_custkey").alias("owner"))


def _lines(spark, sf_dir):
    """Line items as analyses of postings."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("analysis_id"), F.col("l_shipdate").alias("created"), F.col("l_quantity").cast("double").alias("score"), F.col("l_returnflag").alias("classification"))


_JOBS = "SELECT o_orderkey AS id, o_orderpriority AS title, n_name AS location, o_orderstatus AS status, o_orderdate AS discovered, o_totalprice AS salary_max FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_BEST = "SELECT l_orderkey, arg_max(l_quantity::DOUBLE, (l_shipdate, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey)) AS score, arg_max(l_returnflag, (l_shipdate, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey)) AS classification FROM lineitem GROUP BY 1"
_PAGE = "SELECT id, title, location, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({page}) p LEFT JOIN ({best}) b ON p.id = b.l_orderkey {where}) WHERE rank <= 50"
_NEWEST = f"SELECT * FROM ({_JOBS}) WHERE status <> 'F' {{more}} ORDER BY discovered DESC, id DESC LIMIT {{n}}"


def _page(d):
    return d.select("id", "title", "location", "rank")


@query(_PAGE.format(order="discovered DESC, id DESC", page=_NEWEST.format(more="", n=51), best=_BEST, where=""))
def feed_recent(spark, sf_dir):
    return _page(feed.feed(_jobs(spark, sf_dir), _lines(spark, sf_dir), where=F.col("status") != "F"))


@query(_PAGE.format(order="coalesce(score, 0) DESC, discovered DESC, id DESC", page=_NEWEST.format(more="", n=150), best=_BEST, where=""))
def feed_match(spark, sf_dir):
    return _page(feed.feed(_jobs(spark, sf_dir), _lines(spark, sf_dir), sort="match", where=F.col("status") != "F"))


@query(_PAGE.format(order="coalesce(salary_max, 0) DESC, discovered DESC, id DESC", page=_NEWEST.format(more="", n=150), best=_BEST, where="WHERE coalesce(score, 0) >= 10 AND classification = 'N'"))
def feed_salary(spark, sf_dir):
    post = feed.after_limit(min_score=10, classification="N")
    return _page(feed.feed(_jobs(spark, sf_dir), _lines(spark, sf_dir), sort="salary", where=F.col("status") != "F", post=post))


_KEYSET = f"(discovered < TIMESTAMP '{EPOCH}' OR (discovered = TIMESTAMP '{EPOCH}' AND id < 1000)) AND (title ILIKE '%urgent%' OR location ILIKE '%urgent%')"


@query(_PAGE.format(order="discovered DESC, id DESC", page=f"SELECT * FROM ({_JOBS}) WHERE {_KEYSET} ORDER BY discovered DESC, id DESC LIMIT 51", best=_BEST, where=""))
def feed_keyset(spark, sf_dir):
    where = feed.conditions(search=" urgent ", include_dismissed=True, cursor=(F.lit(EPOCH).cast("timestamp_ntz"), 1000))
    return _page(feed.feed(_jobs(spark, sf_dir), _lines(spark, sf_dir), where=where))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_group(spark, sf_dir):
    return feed.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_by_aggregate(spark, sf_dir):
    d = feed.latest_struct(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderdate", "o_orderkey")
    return d.select("o_custkey", "latest.o_orderkey")


@query("SELECT l_orderkey AS job_id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS analysis_id, rn AS rank, s - l_quantity::DOUBLE AS delta FROM (SELECT *, row_number() OVER w AS rn, first_value(l_quantity::DOUBLE) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey DESC)) WHERE rn <= 3")
def score_history(spark, sf_dir):
    return feed.score_history(_lines(spark, sf_dir)).select("job_id", "analysis_id", "rank", "delta")


@query("SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def nested_detail(spark, sf_dir):
    lines = feed.nested(table(spark, sf_dir, "lineitem"), "l_orderkey", "lines", ["l_linenumber", "l_partkey", "l_suppkey"])
    d = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parts = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return d.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(parts, F.lit("")).alias("parts"))


@query("SELECT o_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey) AS names FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def evidence_by_ids(spark, sf_dir):
    ids = feed.nested(table(spark, sf_dir, "lineitem"), "l_orderkey", "lines", ["l_linenumber", "l_partkey", "l_suppkey"])
    owners = ids.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("lines", lambda x: x["l_partkey"]).alias("ids"))
    found = feed.by_ids(owners, "o_orderkey", "ids", table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return found.select("o_orderkey", F.array_join("found", "; ").alias("names"))


# ---- counts ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT * FROM (SELECT count(*) AS total_jobs, count(*) FILTER (o_totalprice > 200000) AS saved_jobs, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS strong_matches,
    count(*) FILTER (o_orderdate >= TIMESTAMP '{EPOCH}') AS new_this_week, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_totalprice > 200000) AS strong_unseen FROM orders WHERE o_orderstatus <> 'F'),
    (SELECT count(*) FILTER (event_type = 'purchase') AS applied, count(*) FILTER (event_type IN ('click', 'view')) AS interviews, count(*) FILTER (event_type = 'signup') AS offers FROM events),
    (SELECT count(*) FILTER (c_acctbal < 0) AS boards_needing_attention FROM customer)"""
)
def dashboard_stats(spark, sf_dir):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "excellent").when(F.col("o_orderpriority") == "2-HIGH", "strong").otherwise("possible")
    jobs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "dismissed").otherwise("new").alias("status"), (F.col("o_totalprice") > 200000).alias("saved"), level.alias("classification"), F.col("o_orderdate").alias("discovered"))
    step = F.col("event_type")
    apps = table(spark, sf_dir, "events").select(F.when(step == "purchase", "applied").when(step.isin("click", "view"), "recruiter_screen").when(step == "signup", "offer").otherwise("draft").alias("status"))
    boards = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") >= 0, F.lit(1)).alias("polled"), F.lit(1).alias("new_jobs"), F.lit(1).alias("filtered"))
    return dashboard.stats(jobs, apps, boards, F.lit(EPOCH).cast("timestamp_ntz"))


@query("SELECT s_suppkey, coalesce(n, 0) AS job_count, s_acctbal > 0 AND coalesce(n, 0) = 0 AS consider_removing FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1) ON s_suppkey = l_suppkey")
def board_health(spark, sf_dir):
    boards = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.lit(1)).alias("polled"), F.lit(0).alias("new_jobs"))
    jobs = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    return dashboard.board_health(boards, jobs, "s_suppkey").select("s_suppkey", "job_count", "consider_removing")


_FLAGS = {"license": "licen[cs]e", "table": "[|]", "shout": "[A-Z]{5}", "number": "[0-9]{6}"}


@query("SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {k}_count, count(*) FILTER (regexp_matches(text, '{p}')) > 0 AS has_{k}" for k, p in _FLAGS.items()) + " FROM documents GROUP BY source")
def signals_by_group(spark, sf_dir):
    return dashboard.signals_by(table(spark, sf_dir, "documents"), "source", {k: F.col("text").rlike(p) for k, p in _FLAGS.items()})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_tally(spark, sf_dir):
    return registry.tally(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def status_columns(spark, sf_dir):
    statuses = spark.createDataFrame([("O",), ("F",), ("P",), ("X",)], "status string")
    counted = registry.tally(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status")
    return dashboard.with_all_statuses(counted, statuses, "status")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, sum(floor(value * 10 + 0.5)) AS tenths FROM events GROUP BY 1")
def round_half_up(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.sum(F.round(text.round_tenth(F.col("value")) * 10)).alias("tenths"))


@query("SELECT count(*) AS total, count(*) FILTER (value >= 10) AS ok, count(*) FILTER (value < 10) AS failed, sum(event_id) AS found, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS new_jobs, sum(user_id) AS filtered FROM events")
def poll_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.when(F.col("value") < 10, "timeout").alias("error"), F.col("event_id").alias("found"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("new_jobs"), F.col("user_id").alias("filtered"))
    return incremental.poll_summary(runs)


# ---- registry --------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_type = 'ECONOMY' AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring'))")
def catalog_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "lever").otherwise("ashby").alias("provider"), F.split("p_type", " ").alias("industries"), F.col("p_name").alias("name"), F.col("p_brand").alias("id"), F.col("p_type").alias("slug"))
    return registry.filter_catalog(part, provider="lever", industry="ECONOMY", search="RING").select("p_partkey")


@query(
    """SELECT p_partkey, points FROM (SELECT p_partkey, p_name, (CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END) + (CASE WHEN p_size >= 25 THEN 2 ELSE 0 END) + (CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS points
    FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) WHERE points > 0 ORDER BY points DESC, p_name, p_partkey LIMIT 8"""
)
def suggest_top8(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("order", F.concat("p_name", F.lit("\x00"), F.lpad(F.col("p_partkey").cast("string"), 20, "0")))
    followed = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    points = [(F.col("p_type") == "PROMO", 3), (F.col("p_size") >= 25, 2), (F.col("p_retailprice") > 1500, 1)]
    return registry.suggest(part, points, followed, "p_partkey", "order").select("p_partkey", "points")


@query(
    r"""WITH e AS (SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS key, s_nationkey AS country FROM supplier WHERE s_acctbal > 2000),
    c AS (SELECT c_custkey AS id, replace(c_name, 'Customer', 'Supplier') AS name, lower(replace(c_name, 'Customer', 'Supplier')) AS key, c_nationkey AS country FROM customer)
    SELECT coalesce(e.key, c.key) AS key, coalesce(c.name, e.name) AS name, coalesce(c.country, e.country) AS country, e.key IS NOT NULL AS known FROM e FULL JOIN c ON e.key = c.key"""
)
def registry_merge(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    slug = lambda col: F.regexp_replace(F.lower(col), "[^a-z0-9]", "-")
    existing = s.filter("s_acctbal > 2000").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("lever").alias("provider"), slug(F.col("s_name")).alias("slug"), F.lit("u").alias("url"), F.col("s_nationkey").cast("string").alias("country"), none.alias("industries"), F.lit("verified").alias("status"))
    name = F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier"))
    found = c.select(F.lit("lever").alias("provider"), slug(name).alias("slug"), F.col("c_custkey").alias("pos"), name.alias("name"), F.lit(None).cast("string").alias("url"), F.col("c_nationkey").cast("string").alias("country"), none.alias("industries"))
    d = registry.merge_entries(existing, found)
    return d.select(F.lower("name").alias("key"), "name", F.col("country").cast("int").alias("country"), (F.col("status") == "verified").alias("known"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_size) > 1 AND p_size > 10 THEN 'lever-' || regexp_replace(lower(p_brand), '[^a-z0-9-]', '-', 'g') ELSE p_size::VARCHAR END AS id FROM part")
def id_collision(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("id"), F.when(F.col("p_size") > 10, "lever").otherwise("greenhouse").alias("provider"), F.col("p_brand").alias("slug"))
    return registry.unique_ids(part).select("p_partkey", "id")


@query("SELECT p_partkey, p_size || CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) > 1 THEN '-ashby' ELSE '' END AS id FROM part")
def id_suffix(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("pos"), F.col("p_size").cast("string").alias("id"), F.lit("ashby").alias("provider"))
    return registry.suffixed_ids(part).select("p_partkey", "id")


@query("SELECT event_id FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events) WHERE spent < 2")
def capped_intake(spark, sf_dir):
    return incremental.capped(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", 2, ["ts", "event_id"], "user_id").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def match_queue(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("discovered"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("matched").alias("match_status"))
    return incremental.queue(jobs).select(F.col("id").alias("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    left = incremental.cascade_delete(gone, "o_orderkey", {"lines": (table(spark, sf_dir, "lineitem"), "l_orderkey")})
    return left["lines"].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS found FROM customer LEFT JOIN (SELECT s_suppkey, s_suppkey AS k FROM supplier) a ON c_custkey = a.k LEFT JOIN (SELECT min(s_suppkey) AS s_suppkey, s_nationkey FROM supplier GROUP BY 2) b ON c_nationkey = b.s_nationkey")
def lookup_either_key(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), "s_suppkey")
    return feed.either_key(left, right, "k", "n", "s_suppkey").select("c_custkey", "found")


@query("SELECT n_name, count(*) AS n, floor(sum(o_totalprice)) AS total FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c.c_custkey JOIN customer ON o_custkey = customer.c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def owned_rows(spark, sf_dir):
    owners = table(spark, sf_dir, "customer")
    owned = table(spark, sf_dir, "orders").join(owners.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    d = owned.join(owners, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("o_totalprice")).cast("double").alias("total"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(sales|recruiter)($|[^A-Za-z0-9_])') THEN 'blocked' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(la|der|the)($|[^A-Za-z0-9_])') THEN 'article' ELSE 'none' END AS class FROM documents"""
)
def word_edges(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(signals.says(c, ["sales|recruiter"]), "blocked").when(signals.says(c, ["la|der|the"]), "article").otherwise("none").alias("class"))


# ---- extensions: what the tables invite beyond the postings ----------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts)::VARCHAR AS first_ts FROM g GROUP BY 1, 2"""
)
def event_sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    apart = F.col("ts") - F.lag("ts").over(w)
    e = e.withColumn("opens", F.when(apart <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    e = e.withColumn("session", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_ts"))


@query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_orders(spark, sf_dir):
    """The last order of an event's user up to the event: one sort of both tables together, where an inequality join would form all earlier pairs."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    o = o.select("k", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = W.partitionBy("k").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return d.filter("side = 1").select("event_id", "o_orderkey")
