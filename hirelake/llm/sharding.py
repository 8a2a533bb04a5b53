"""Sharding by histogram sort: shards are key ranges of nearly equal bytes.

The key is a hash of the text, then doc_id, then a number that tells repeated rows apart, so equal texts
lie together and are cut only where a shard would else miss its share. Each round counts the exact bytes
and rows below a set of candidate boundaries, in every partition, and puts new candidates between the
two that enclose a target. When all boundaries meet the tolerance, the documents are exchanged once.

The counts of the last round give each range its first slot, so slots need no further pass. Ranges are
finer than shards, so that no task holds a whole shard. Null texts have size 1; null ids sort first; ids of
any type do, since other than whole numbers they count by their hash; an empty table gives an empty result. All
columns travel along; where one is named size, shard or slot, the new column of that name gets `_` appended.
"""

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from hirelake.llm.common import free_name, free_names, materialise

SHARDS = 16
TOLERANCE = 0.002  # of a shard's bytes, or one document where that is more
RANGE_BYTES = 8 << 20
MOST_RANGES = 16_384  # boundaries are sent to every task
PROBES = 8  # candidates between two counted boundaries
ROUNDS = 80  # a round cuts a span to a ninth, and three parts of 64 bits are used up after 63
LOW, HIGH = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int, int]


@dataclass
class Cut:
    """A boundary under search. Rows below a boundary have a smaller key; low and high are counted boundaries around the
    target, and span holds the least and the greatest value of each part of the keys between them."""

    target: float
    low: Key
    low_bytes: int
    low_rows: int
    high: Key
    high_bytes: int
    high_rows: int
    span: list[tuple[int, int]]

    def nearest(self) -> tuple[Key, int, int]:
        ends = (self.low, self.low_bytes, self.low_rows), (self.high, self.high_bytes, self.high_rows)
        return min(ends, key=lambda x: abs(x[1] - self.target))

    def met(self, slack: float) -> bool:
        return abs(self.nearest()[1] - self.target) <= slack

    def candidates(self, n: int) -> list[Key]:
        """Boundaries between low and high, in the first part in which the keys there differ; none if they are all equal."""
        part = next((i for i, (a, b) in enumerate(self.span) if a != b), None)
        if part is None:
            return []
        a, b = self.span[part]
        share = (self.target - self.low_bytes) / max(1, self.high_bytes - self.low_bytes)
        head = [x for x, _ in self.span[:part]]
        return [(*head, v, *[LOW] * (2 - part)) for v in _between(a, b, n, share)]


def _between(a: int, b: int, n: int, share: float) -> list[int]:
    """Values above a, up to b: spread evenly, and close to where the target should be."""
    width = b - a
    even = [a + width * (i + 1) // (n + 1) for i in range(n)]
    near = [a + int(width * min(1.0, max(0.0, share + d))) for d in (-0.02, -0.002, 0.0, 0.002, 0.02)]
    return sorted({min(b, max(a + 1, v)) for v in even + near})


def bucket_of(keys: list[Key]):
    """Column function: which of the ranges between sorted boundaries a row (h, d, s) is in."""
    first = np.array([k[0] for k in keys], dtype=np.int64)
    doubtful = np.unique(first)

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, d, s in parts:
            hs = h.to_numpy()
            at = np.searchsorted(first, hs, side="right")
            for i in np.nonzero(np.isin(hs, doubtful))[0]:
                at[i] = bisect.bisect_right(keys, (int(hs[i]), int(d.iat[i]), int(s.iat[i])))
            yield pd.Series(at.astype(np.int64))

    return F.pandas_udf(run, "long")


def _spans() -> list[Column]:
    return [f(c).alias(f"{name}_{c}") for c in "hds" for name, f in (("min", F.min), ("max", F.max))]


def boundaries(keyed: DataFrame, targets: list[float], slack: float) -> list[tuple[Key, int, int]]:
    """For each target the boundary key, and the exact bytes and rows below it. keyed: h, d, s (long) and size."""
    count = [F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), *_spans()]
    span = lambda r: [(r[f"min_{c}"], r[f"max_{c}"]) for c in "hds"]
    whole = keyed.agg(*count).first()
    total, rows = int(whole["size"]), int(whole["rows"])
    cuts = [Cut(t, (LOW, LOW, LOW), 0, 0, (HIGH, HIGH, HIGH), total, rows, span(whole)) for t in targets]
    for _ in range(ROUNDS):
        open_ = [c for c in cuts if not c.met(slack)]
        if not any(c.candidates(PROBES) for c in open_):
            break
        keys = sorted({k for c in open_ for k in (*c.candidates(PROBES), c.low, c.high)})
        found = {r["b"]: r for r in keyed.groupBy(bucket_of(keys)("h", "d", "s").alias("b")).agg(*count).collect()}
        size = [int(found[i]["size"]) if i in found else 0 for i in range(len(keys) + 1)]
        n = [int(found[i]["rows"]) if i in found else 0 for i in range(len(keys) + 1)]
        below_bytes, below_rows = np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist()
        for c in open_:
            first, last = bisect.bisect_left(keys, c.low), bisect.bisect_left(keys, c.high)
            i = min(last, max(first + 1, bisect.bisect_left(below_bytes, c.target)))
            c.low, c.low_bytes, c.low_rows = keys[i - 1], below_bytes[i - 1], below_rows[i - 1]
            c.high, c.high_bytes, c.high_rows = keys[i], below_bytes[i], below_rows[i]
            c.span = span(found[i]) if i in found else [(0, 0)] * 3
    return [c.nearest() for c in cuts]


def shard(docs: DataFrame, text: Column | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The columns of `docs` plus size (UTF-8 bytes of the text plus 1), shard (from 0) and slot (gapless from 0 in each shard)."""
    text = F.col("text") if text is None else text
    row, new = free_name(docs.columns, "_row"), free_names(docs.columns, "size", "shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    whole = isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType))
    d = F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(LOW))
    keyed = docs.select(F.struct(*docs.columns).alias(row), size.alias("size"), h.alias("h"), d.alias("d"), F.monotonically_increasing_id().alias("s"))
    # keys and documents must agree on s, so both come from what is written here
    keyed = materialise(keyed, "shard-keys")
    slim = keyed.select("h", "d", "s", "size")
    stat = slim.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = int(stat["total"] or 0), int(stat["rows"])
    per_shard = max(1, min(MOST_RANGES // shards, math.ceil(total / shards / RANGE_BYTES)))
    n = shards * per_shard
    targets = [total * i / n for i in range(1, n)]
    found = sorted(boundaries(slim, targets, tolerance * total / shards)) if rows else []
    keys, first = [k for k, *_ in found], [0, *(r for *_, r in found)]
    starts = docs.sparkSession.createDataFrame([(i, i // per_shard, int(first[i] - first[i - i % per_shard])) for i in range(len(first))], "_range long, shard int, _first long")
    ranged = keyed.withColumn("_range", bucket_of(keys)("h", "d", "s") if keys else F.lit(0).cast("long"))
    # the one exchange, into as many parts as there are ranges: what a task sorts doesn't grow with the table
    ranged = ranged.repartition(n, "_range")
    at = F.row_number().over(W.partitionBy("_range").orderBy("h", "d", "s"))
    placed = ranged.withColumn("_at", at - 1).join(F.broadcast(starts), "_range")  # MOST_RANGES rows at most
    return placed.select(f"{row}.*", F.col("size").alias(new["size"]), F.col("shard").alias(new["shard"]), (F.col("_first") + F.col("_at")).cast("long").alias(new["slot"]))
