"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import byte_bpe, conversation_trie, decontam, importance, licenses, mixing, ngram_join, pii, quality, sharding, substrings, token_counts, warc
from hirelake.llm.common import n_words, read


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.match_windows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_id")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"), F.xxhash64("doc_id", "source", "text").alias("key"))
    mixed = mixing.mix(docs, size=F.col("words"), row_key=F.col("key"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark)).drop("text")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), keep=["doc_id"]))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.forked_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_license_scan": op10_license_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_importance": op12_importance,
    "op13_prefix_trie": op13_prefix_trie,
}

# ---- SQL ---------------------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM again),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS s FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=_LOWER)} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 90 * (a.n + b.n - m)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.node)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(node) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id"""


# the table that crc32 looks its 256 bytes up in
_CRC_TABLE = "tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(i)))"
_GRAMS = f"list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTES = "CASE WHEN strlen(f) = length(f) THEN list_transform(string_split(f, ''), lambda c: ascii(c)::BIGINT) ELSE list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT) END"
_IMPORTANCE = f"""WITH {_CRC_TABLE}, w AS (SELECT doc_id, {_LETTERS} AS ws FROM documents), g AS (SELECT doc_id, len(ws) AS n, {_GRAMS} AS fs FROM w),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(fs) AS f FROM g) GROUP BY ALL), bf AS (SELECT f, count(*) AS n FROM (SELECT unnest({_GRAMS}) AS f FROM (SELECT {_LETTERS} AS ws FROM benchmark)) GROUP BY ALL),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS b FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
s AS (SELECT b, sum(n) AS s FROM df JOIN c USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM bf JOIN c USING (f) GROUP BY b),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM df JOIN c USING (f) JOIN gain USING (b) GROUP BY doc_id),
y AS (SELECT g.doc_id, n, len(fs) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || g.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM g LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n >= 20 QUALIFY rank <= (SELECT count(*) FROM y WHERE n >= 20) * 5 // 100)
SELECT y.doc_id, n_features, weight, score, rank FROM y LEFT JOIN r USING (doc_id)"""

# crc32 of a decimal number
_TRIE = f"""WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id AS c, count(*) AS own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, any_value(tab)[1 + (xor(a, b) & 255)])), 4294967295) % 4 AS h FROM t, tab GROUP BY conv_id),
turns AS (SELECT c, pos AS d, role, text FROM n JOIN t ON t.conv_id = c - c % 20 AND pos <= h UNION ALL SELECT c, pos - h + least(h, coalesce((SELECT b.own FROM n b WHERE b.c = n.c - n.c % 20), 0)), role, text FROM n JOIN t ON t.conv_id = c AND pos > h),
seqs AS (SELECT n.c, list(turns.role || chr(0) || turns.text ORDER BY d) FILTER (d IS NOT NULL) AS s, list(len(regexp_extract_all(turns.text, '[^\\x20\\x09-\\x0D]+')) ORDER BY d) FILTER (d IS NOT NULL) AS w FROM n LEFT JOIN turns ON turns.c = n.c GROUP BY n.c),
p AS (SELECT c, d, coalesce(s, [])[1:d] AS k, coalesce(len(s), 0) = d AS ends, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, coalesce(len(s), 0) + 1)) AS d FROM seqs)),
g AS (SELECT d, k, min(c) AS v, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM p GROUP BY d, k),
m AS (SELECT p.c, p.d, g.v FROM p JOIN g ON g.d = p.d AND g.k = p.k),
q AS (SELECT g.*, m.v AS parent FROM g LEFT JOIN m ON m.c = g.v AND m.d = g.d - 1),
kids AS (SELECT parent AS v, d - 1 AS d, count(*) AS n FROM q WHERE d > 0 GROUP BY ALL),
r AS (SELECT q.*, coalesce(kids.n, 0) AS n_children FROM q LEFT JOIN kids ON kids.v = q.v AND kids.d = q.d),
sub AS (SELECT m.v, m.d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM r JOIN m ON m.c = r.v AND m.d <= r.d GROUP BY m.v, m.d)
SELECT r.v AS conv_id, r.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(e) AS ends_sha256 FROM r JOIN sub ON sub.v = r.v AND sub.d = r.d"""


def _canonical_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{licenses.COPYRIGHT_LINE}', '', 'g'), '{licenses.RESERVED_LINE}', '', 'g')"
    ws = f"list_filter(string_split_regex({t}, '{licenses.NOT_LETTERS}'), lambda w: w <> '')"
    one = ", ".join(f"'{old}': '{new}'" for old, new in licenses.SPELLINGS if " " not in old)
    ws = f"list_transform({ws}, lambda w: coalesce(MAP {{{one}}}[w], w))"
    joined = f"array_to_string({ws}, ' ')"
    for old, new in licenses.SPELLINGS:  # words of a pair start or end no other pair
        if " " in old:
            joined = rf"regexp_replace({joined}, '(^| ){old}( |$)', '\1{new}\2', 'g')"
    return f"sha256({joined})"


def _license_sql() -> str:
    rows = [(k, "text", t) for k, t in licenses.TEXTS.items()] + [(k, "notice", t) for k, ts in licenses.NOTICES.items() for t in ts]
    quoted = ", ".join("('{}', '{}', '{}')".format(k, kind, t.replace("'", "''")) for k, kind, t in rows)
    return f"""WITH known AS (SELECT id, kind, {_canonical_sql("body")} AS digest FROM (VALUES {quoted}) AS t(id, kind, body)),
    whole AS (SELECT digest, min(id) AS id FROM known GROUP BY digest), notice AS (SELECT digest, min(id) AS id FROM known WHERE kind = 'notice' GROUP BY digest),
    line AS (SELECT doc_id, pos, {_canonical_sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents) WHERE regexp_matches(line, '{licenses.NOTICE_WORDS}')),
    said AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS notices FROM (SELECT doc_id, id, min(pos) AS pos FROM line JOIN notice USING (digest) GROUP BY ALL) GROUP BY doc_id)
    SELECT d.doc_id, d.digest AS canonical_sha256, whole.id AS license_id, notices FROM (SELECT doc_id, {_canonical_sql("text")} AS digest FROM documents) d LEFT JOIN whole USING (digest) LEFT JOIN said ON said.doc_id = d.doc_id"""


ORACLES: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRINGS,
    "op7_ngram_jaccard": _JACCARD,
    "op10_license_scan": _license_sql(),
    "op12_importance": _IMPORTANCE,
    "op13_prefix_trie": _TRIE,
}
