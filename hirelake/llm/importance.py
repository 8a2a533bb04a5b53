"""Importance resampling towards a target distribution, by hashed n-gram features and Gumbel top-k.

Overlapped regex scanning: a text is lower-cased (A-Z), its separators become single blanks, and a finditer with
overlapped=True, bounded by blanks, gives for each place where a word starts the spans of 1 to 3 words from there.
Each span's CRC-32 names a bucket. A text is scanned once: its sorted buckets are kept as gaps of a byte each, and both
the counts of the corpus and the weight of each document are taken from them.

The counts of the buckets (BUCKETS rows whatever the corpus) go to the driver, where gains are made of them; a
document's weight is the sum of the gains over its features. Its score adds Gumbel noise that a hash of seed and id
fixes, so that the highest scores are a sample without replacement and reruns agree. Scores are ranked by an exchange
into ranges and the counts of these, never in one task.

Null texts, and texts without words, have no features, weight 0 and are not drawn unless `least_words` is 0. A null id
hashes as an empty one and comes last among ties; equal rows are ranked in the order they are read in. Texts of any
length are scanned SCANNED matches at a time. An empty corpus gives an empty result; an empty target counts 0 in every
bucket. The columns of the input stay; where one has the name of a new column, the new one gets `_` appended.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from hirelake.llm.common import free_names, materialise

BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
SCANNED = 100_000
BATCH_ROWS = 1_000
ADDED = ("n_features", "weight", "score", "rank")

#: Letters and digits are word characters, and all bytes of characters from U+0080 on; A-Z become a-z, the rest blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = rb"[^ ]+(?= )"
#: From the blank before a word: the spans of up to three, up to two and one word.
_SPANS = regex.compile(rb" (((%s)(?: %s)?)(?: %s)?)" % (_WORD, _WORD, _WORD))


def scan(text: bytes) -> tuple[int, np.ndarray]:
    """(words, bucket of every feature) of a text in UTF-8."""
    found = text.translate(_FOLD).split()
    n = len(found)
    line = b" " + b" ".join(found) + b" "
    del found
    matches, parts = _SPANS.finditer(line, overlapped=True), []
    while some := list(map(regex.Match.groups, islice(matches, SCANNED))):
        parts.append(np.fromiter(map(crc32, chain.from_iterable(some)), np.uint32, 3 * len(some)) % BUCKETS)
    if not n:
        return 0, np.zeros(0, np.uint32)
    buckets = np.concatenate(parts)
    # fewer than three words follow the last but one and the last word: their shorter spans came again
    return n, np.delete(buckets, [3 * n - 3, 3 * n - 2, *([3 * n - 6] if n > 1 else [])])


def pack(buckets: np.ndarray) -> bytes:
    """Sorted buckets as gaps; 255 stands for 255 and goes on with the next byte."""
    gap = np.diff(np.sort(buckets).astype(np.int64), prepend=0)
    full = gap // 255
    out = np.full(len(gap) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full) + np.arange(len(gap))] = gap - full * 255
    return out.tobytes()


def unpack(data) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _scanned(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rest = [c for c in whole.schema.names if c != text]
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                words, features, packed = [], [], []
                for t in batch.column(text):
                    n, buckets = scan(t.as_buffer().to_pybytes()) if t.is_valid else (0, np.zeros(0, np.uint32))
                    words.append(n)
                    features.append(len(buckets))
                    packed.append(pack(buckets))
                new = [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *new], names=[*rest, "_words", "_features", "_packed"])

    return run


def features(rows: DataFrame, text: str = "_text") -> DataFrame:
    """rows without their text, with _words, _features and _packed: one pass over the texts."""
    kept = [f for f in rows.schema.fields if f.name != text]
    new = [StructField("_words", LongType()), StructField("_features", LongType()), StructField("_packed", BinaryType())]
    return rows.mapInArrow(_scanned(text), StructType([*kept, *new]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column("_packed"):
            total += np.bincount(unpack(data.as_buffer()), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])


def bucket_counts(scanned: DataFrame) -> np.ndarray:
    """How many features fall in each bucket, as floats."""
    found = scanned.select("_packed").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) of each bucket."""
    s, t = float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + BUCKETS) / ((source + 1.0) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[unpack(x.as_buffer())].sum()) for x in batch.column("_packed")]
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("_h").to_pylist()]
            score = [w + g for w, g in zip(weight, noise, strict=True)]
            kept = [c for c in batch.schema.names if c not in ("_packed", "_h")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=[*kept, "_weight", "_score"])

    return run


def _ranks(scored: DataFrame, draw: int) -> DataFrame:
    """_id and _rank of the `draw` highest scores. An exchange into ranges sorts them; a row's rank is the number of rows in
    the ranges before its own, plus its place in it."""
    order = [F.col("_score").desc(), F.col("_key").asc_nulls_last(), F.col("_id").asc()]
    placed = scored.select("_score", "_key", "_id").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.select("_id", F.monotonically_increasing_id().alias("_at")), "importance-order")
    part = F.shiftright("_at", 33)
    before, rows = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        rows.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(rows, "_part long, _before long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.join(offsets, part == F.col("_part")).select("_id", (F.col("_before") + inside + 1).alias("_rank"))
    return ranked.filter(F.col("_rank") <= draw)


def score_documents(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns of `docs` (or those in `keep`) with n_features, weight, score and rank: 1 for the highest score, null for
    what is not drawn. `percent` of the documents with `least_words` words are drawn, rounded down. target: has `text` too."""
    keep = docs.columns if keep is None else keep
    new = free_names(keep, *ADDED)
    body = F.col(text).cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(key).alias("_key"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("_h"), F.monotonically_increasing_id().alias("_id"), body.alias("_text"))
    scanned = materialise(features(rows), "importance-features")
    gain = gains(bucket_counts(scanned), bucket_counts(features(target.select(body.alias("_text")))))
    weighed = StructType([*(f for f in scanned.schema.fields if f.name not in ("_packed", "_h")), StructField("_weight", LongType()), StructField("_score", LongType())])
    scored = materialise(scanned.mapInArrow(_weigher(gain), weighed), "importance-scores")
    eligible = scored.filter(F.col("_words") >= least_words)
    draw = percent * eligible.count() // 100
    if draw:
        scored = scored.join(_ranks(eligible, draw), "_id", "left")
    else:
        scored = scored.withColumn("_rank", F.lit(None).cast("long"))
    added = zip(("_features", "_weight", "_score", "_rank"), new.values(), strict=True)
    return scored.select("_row.*", *(F.col(c).alias(name) for c, name in added))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with the columns of `docs`."""
    scored = score_documents(docs, target, **options)
    return scored.filter(F.col(free_names(docs.columns, *ADDED)["rank"]).isNotNull()).select(*docs.columns)
