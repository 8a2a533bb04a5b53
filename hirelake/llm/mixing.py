"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the target of its source over the
source's size. The whole part is given outright. The fractional parts are copy probabilities: mass moves from one to others, in
words, until one is 0 or 1. The largest open document goes first and against all smaller ones of its probability at once:
one draw says whether it gets a copy, and they share what that takes or gives, in proportion to their words, so that
they stay alike. Documents of different probabilities are settled two at a time. What stays
fractional in a group of documents is one document at most, the smallest as a rule; these residuals meet in the next
level of a reduction tree until a source has one, which a last draw decides. So a source's words miss its target
by less than one document, a small one where the others can make up for large ones; every document keeps its
expected copies, and no sum is left to chance.

Groups are made from hashes of the documents, and every draw comes from those hashes, so that reruns
agree however the rows are partitioned. Rows that are equal in id, source and text are one unit with a count: of
n such rows with copy probability p, floor(n * p) get a copy outright and the rest is the unit's probability, so
that n equal rows are rounded as one. Only keys, sizes and probabilities are rounded; texts are joined back.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; an
empty table gives an empty mix. Columns travel along unchanged; where one is named size, source_size, target or
copies, the new column of that name gets `_` appended. The table of sources, one row each, goes to the driver: more
than MOST_SOURCES of them are an error.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import free_name, free_names, made, materialise, n_words, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
GROUP_ROWS = 2_000  # documents that one task rounds at a time
FAN_IN = 1_000  # residuals that meet in a node of the tree
MOST_SOURCES = 1_000_000
ADDED = ("size", "source_size", "target", "copies")


def allot(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Target of each source: by weight, none above `most` times its size; what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    cap = {name: float(most * size) for name, size in order}
    rest, open_, target = share * sum(size for _, size in order), dict(weight), {}
    while open_:
        unit = rest / sum(open_.values())
        full = [name for name, w in open_.items() if w * unit >= cap[name]]
        if not full:
            return target | {name: w * unit for name, w in open_.items()}
        for name in full:
            target[name] = cap[name]
            rest -= cap[name]
            del open_[name]
    return target


def _draw(seed: int, salt: int) -> float:
    """A number in [0, 1) that depends on the document alone."""
    x = (seed ^ (salt * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def pivot(p: list[float], size: list[int], seed: list[int], salt: int) -> list[float]:
    """Pivotal rounding of copy probabilities p in the given order. The sum of p * size stays; one p at most stays fractional."""
    out, tiny, open_ = list(p), 1e-9, -1
    for i in range(len(out)):
        if out[i] <= tiny or out[i] >= 1 - tiny:
            out[i] = float(round(out[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        # words that i can give to j, and j to i, until one of the two is integral
        give = min(out[i] * size[i], (1 - out[j]) * size[j])
        take = min(out[j] * size[j], (1 - out[i]) * size[i])
        move = -give if _draw(seed[i] ^ (seed[j] >> 1), salt) < take / (give + take) else take
        out[i] += move / size[i]
        out[j] -= move / size[j]
        left = [k for k in (i, j) if tiny < out[k] < 1 - tiny]
        for k in (i, j):
            if k not in left:
                out[k] = float(round(out[k]))
        open_ = left[0] if left else -1
    return out


def share(p: list[float], size: list[int], seed: list[int], salt: int) -> list[float]:
    """Rounds documents that all have the same p, in the given order, largest first. Each is drawn against all that follow, which
    stay alike. The sum of p * size stays; one p at most stays fractional."""
    out, tiny = list(p), 1e-9
    now, rest = (p[0] if p else 0.0), sum(size)
    for i in range(len(p)):
        rest -= size[i]
        if now <= tiny or now >= 1 - tiny:
            out[i:] = [float(round(now))] * (len(p) - i)
            break
        # how far this one can go up and down for all that the others can give and take
        up, down = min(1 - now, now * rest / size[i]), min(now, (1 - now) * rest / size[i])
        if up + down <= tiny:
            out[i] = now
            break
        move = up if _draw(seed[i], salt) < down / (up + down) else -down
        out[i] = now + move
        if out[i] < tiny or out[i] > 1 - tiny:
            out[i] = float(round(out[i]))
        if rest:
            now = min(1.0, max(0.0, now - move * size[i] / rest))
    return out


def settle_group(p: list[float], size: list[int], seed: list[int], salt: int) -> list[float]:
    """Those of the commonest probability by share(), then all that is open by pivot()."""
    out = list(p)
    open_ = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    if open_:
        common = Counter(p[i] for i in open_).most_common(1)[0][0]
        alike = [i for i in open_ if p[i] == common]
        for i, x in zip(alike, share([p[i] for i in alike], [size[i] for i in alike], [seed[i] for i in alike], salt), strict=True):
            out[i] = x
    return pivot(out, size, seed, salt + 50)


def mix(docs: DataFrame, source: str = "source", size: Column | None = None, row_key: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The columns of `docs` plus size, source_size, target (double) and copies (int)."""
    size = n_words(F.col("text")) if size is None else size
    key = F.xxhash64(*(F.col(c) for c in ("doc_id", source, "text"))) if row_key is None else row_key
    row, new = free_name(docs.columns, "_row"), free_names(docs.columns, *ADDED)
    rows = materialise(docs.select(F.struct(*docs.columns).alias(row), F.col(source).cast("string").alias("_source"), size.cast("long").alias("size"), key.alias("_seed"), F.monotonically_increasing_id().alias("_id")), "mix-in")
    since = len(made())
    units = rows.groupBy("_source", "size", "_seed").agg(F.count(F.lit(1)).alias("_n"))
    # one row per source: a table of sources, not of documents
    totals = units.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("units")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    target = allot([(r["_source"], r["source_size"]) for r in totals], weights, share, most)
    plan = []
    for r in totals:
        words, goal = r["source_size"], float(target[r["_source"]])
        each = goal / words if words else 0.0
        plan.append((r["_source"], words, goal, math.floor(each + 1e-12), max(0.0, each - math.floor(each + 1e-12)), max(1, math.ceil(r["units"] / GROUP_ROWS))))
    sources = docs.sparkSession.createDataFrame(plan, "_s string, _words long, target double, _whole long, _each double, _groups long")
    sources = F.broadcast(sources) if len(plan) < 100_000 else sources
    with_source = lambda df: df.join(sources, df["_source"].eqNullSafe(sources["_s"])).drop("_s")
    # of the copies that n equal rows get beyond the whole ones, `_sure` are certain
    part = F.when(F.col("size") > 0, F.col("_each") * F.col("_n")).otherwise(F.lit(0.0))
    d = with_source(units).withColumn("_sure", F.floor(part + 1e-9)).withColumn("_p", F.greatest(part - F.col("_sure"), F.lit(0.0)))
    d = d.select("_source", "size", "_seed", "_n", "_sure", "_p", F.pmod(F.xxhash64("_seed"), F.col("_groups")).alias("_group"))
    rounded = settle(_rounded(d, max((n for *_, n in plan), default=1), since), "mix-units", since)
    one = rounded.select(F.col("_source").alias("_of"), "size", "_seed", "_n", (F.col("_sure") + F.col("_p")).cast("long").alias("_more"))
    slim = rows.drop(row).join(one, ["size", "_seed"]).filter(F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    slim = slim.join(_ranks(slim.filter("_n > 1")), "_id", "left")
    slim = slim.select("_id", F.when(F.coalesce("_rank", F.lit(1)) <= F.col("_more"), 1).otherwise(0).alias("_extra"))
    placed = with_source(rows.join(slim, "_id"))
    added = {"size": F.col("size"), "source_size": F.col("_words"), "target": F.col("target"), "copies": (F.col("_whole") + F.col("_extra")).cast("int")}
    return placed.select(f"{row}.*", *(c.alias(new[k]) for k, c in added.items()))


def _rounded(d: DataFrame, groups: int, since: int) -> DataFrame:
    """d with `_p` rounded to 0 or 1, level by level of the tree."""
    levels, nodes = 0, groups
    while nodes > 1:
        levels, nodes = levels + 1, math.ceil(nodes / FAN_IN)
    schema, done = d.schema, []
    for level in range(levels + 1):
        last = level == levels
        rounded = d.groupBy("_source", "_group").applyInArrow(_rounder(level, last), schema)
        if last:
            done.append(rounded)
            break
        rounded = settle(rounded, f"mix-{level}", since) if level == 0 else materialise(rounded, f"mix-{level}")
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(rounded.filter(~open_))
        d = rounded.filter(open_).withColumn("_group", F.floor(F.col("_group") / FAN_IN) if level + 1 < levels else F.lit(0).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _ranks(rows: DataFrame) -> DataFrame:
    """_id and _rank (from 1) among equal rows. Ranks are counted in each part of the table (the upper bits of _id) and
    parts then by their counts, so that equal rows never meet in one task."""
    same = [F.coalesce(F.col("_source"), F.lit("")), F.col("_source").isNull(), F.col("size"), F.col("_seed")]
    d = rows.select("_id", F.struct(*same).alias("_same"), F.shiftright("_id", 33).alias("_part"))
    counts = d.groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy("_same").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_same", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = d.withColumn("_at", F.row_number().over(W.partitionBy("_same", "_part").orderBy("_id")))
    return inside.join(counts, ["_same", "_part"]).select("_id", (F.col("_before") + F.col("_at")).alias("_rank"))


def _rounder(level: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        # large ones first: what is still open at the end is then a small one as a rule
        rows = rows.take(pa.array(np.lexsort((rows["_seed"].to_numpy(), -rows["size"].to_numpy()))))
        seeds = [int(x) & 0xFFFFFFFFFFFFFFFF for x in rows["_seed"].to_pylist()]
        p = settle_group(rows["_p"].to_pylist(), rows["size"].to_pylist(), seeds, level + 1)
        if last:  # one document of the source at most is still fractional
            p = [x if x in (0.0, 1.0) else float(_draw(s, 99) < x) for x, s in zip(p, seeds, strict=True)]
        return rows.set_column(rows.column_names.index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def taken(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each document as often as it was chosen, with the columns of `mixed`. copies: the column of mix() that says how often."""
    name = free_name(mixed.columns, "_copy")
    return mixed.filter(F.col(copies) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(name)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of `docs`."""
    return taken(mix(docs, **options), free_names(docs.columns, *ADDED)["copies"]).select(*docs.columns)
