"""N-gram Jaccard join: the documents linked by the Jaccard similarity of their word n-gram sets, exactly.

The document by n-gram incidence matrix is cut into blocks of columns. How many blocks there are follows
from the sizes: two documents at the threshold differ in at most D n-grams, so of D + 1 blocks one at
least holds the same n-grams in both. Documents that agree on no block are discarded at once; for the
others the product of their rows is accumulated, first with the best-placed document of their block, and
pairs that the bounds on sizes and distances rule out are never formed:

* sizes a <= b link only if 100 * a >= percent * b;
* in a group of documents around one hub, rows are compared by what sets them apart from the group's centre;
* between groups, with distances d to a common document, |d(x) - d(y)| above D rules a pair out;
* pairs already in one component need no product.

So a group of G near copies costs G products, not G * G / 2.

Words are runs of other than blanks and U+0009 to U+000D, with A to Z lower-cased. A text under n words
is one shingle; null and wordless texts have none, link with nothing and are their own component. Equal
texts are one node, so repeated rows and copies add no pairs. A null doc_id never names a component
unless all its rows have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import broadcast_small, drop_scratch, free_name, made, materialise, settle, text_key
from hirelake.llm.components import components
from hirelake.llm.tokens import U, Words, mix, slices

N_WORDS = 3
PERCENT = 90
STEP = 1.25  # ratio of the size classes
HOT = (64, 1024)  # documents that have a column: above each of these numbers it goes further back in the order of columns
MOST_BITS = 1 << 25  # of a bitmap of keys, however many there are
BITS_A_KEY = 16
BROADCAST_ROWS = 500_000  # 32 bytes each
BATCH = 500  # rows of text that go to Python at a time
_MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


class Scheme:
    """Column blocks for pairs whose larger set has a size in (low, high]."""

    def __init__(self, no: int, low: int, high: int, percent: int):
        self.no, self.low, self.high = no, low, high
        self.least = -(-percent * (low + 1) // 100)  # smallest size that can link into this class
        self.differ = (100 - percent) * 2 * high // (100 + percent)
        blocks = self.differ + 1
        for _ in range(8):  # blocks that hold nothing agree for free: have so many more that these don't matter
            self.empty = round(2 * blocks * np.exp(-max(1, self.least) / blocks))
            blocks = self.differ + 1 + self.empty
        self.blocks = blocks


class Schemes:
    def __init__(self, percent: int):
        self.percent, self.all = percent, [Scheme(0, 0, 1, percent)]

    def of(self, size: int) -> list[Scheme]:
        while self.all[-1].least <= size or self.all[-1].high < size:
            low = self.all[-1].high
            self.all.append(Scheme(len(self.all), low, max(low + 1, int(low * STEP)), self.percent))
        return [s for s in self.all if s.least <= size <= s.high and s.differ]


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its n-grams, ascending."""
    h, m = w.hash, len(w.hash)
    gram = np.zeros(m, dtype=np.uint64)
    for k in range(min(n, m)):
        gram[: m - k] += mix(h[k:] * _MULTIPLIERS[k])
    gram = mix(gram)
    for a, b in zip(w.first, w.first[1:], strict=False):
        if b - a >= n:
            yield np.unique(gram[a : b - n + 1])
        elif b > a:
            yield mix(np.array([np.sum(mix(h[a:b] * _MULTIPLIERS[: b - a])) + U(b - a)], dtype=np.uint64))
        else:
            yield h[:0]


def block_keys(grams: np.ndarray, schemes: list[Scheme]) -> np.ndarray:
    """One key for each block of each scheme: a hash of the n-grams in it."""
    spread, out = mix(grams + U(0x51ED270B)), []
    for s in schemes:
        block = ((grams >> U(32)) * U(s.blocks)) >> U(32)
        at = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
        tag = block[at] + (U(s.no) << U(32))
        out.append(mix(np.add.reduceat(spread, at) ^ mix(tag + U(1))))
        if s.blocks - len(at) > s.empty:
            gone = np.setdiff1d(np.arange(s.blocks, dtype=np.uint64), block)
            out.append(mix(mix(gone + (U(s.no) << U(32)) + U(1)) + U(7)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


MORE = 1.5  # columns of a prefix for each that decides


def fewest_shared(size: Column, percent: int) -> Column:
    """How many columns a row shares with any row that it links with, at least, within the prefixes of both: of what two
    rows have in common, all is in the prefix that ends first but what comes after it in that row."""
    after = lambda n: n - F.least(F.floor((n - F.ceil(percent * n / 100) + 1) * MORE), n)
    partners = F.sequence(F.ceil(percent * size / 100), F.floor(100 * size / percent))
    return F.array_min(F.transform(partners, lambda n: F.ceil(percent * (size + n) / (100 + percent)) - F.greatest(after(size), after(n))))


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys.view(np.int64), len(bitmap) * 64)
    return ((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).astype(bool)


def prefix_keys(grams: np.ndarray, percent: int, hot: list[np.ndarray], more: float) -> np.ndarray:
    """The first columns of a row, `more` times as many as decide: with so many as decide two rows at the threshold share
    one, whatever the order of columns, if it is one order for all rows, and with k more they share k + 1. Here columns
    that many rows have come last."""
    if not len(grams):
        return grams.view(np.int64)
    most = len(grams) - -(-percent * len(grams) // 100) + 1
    if hot:
        grams = grams[np.argsort(sum(has_bit(b, grams).astype(np.int8) for b in hot), kind="stable")]
    return grams[: int(most * more)].view(np.int64)


def _early(n: int, percent: int):
    """The first columns of each row by hash, twice as many as are used, to count how many rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in slices(batch.column("_text"), lower=True):
                keys = [prefix_keys(g, percent, [], 2 * MORE) for g in shingle_sets(w, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["key"])

    return run


def _signed(n: int, percent: int, hot: list[Broadcast] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Schemes(percent)
        for batch in batches:
            for a, b, w in slices(batch.column("_text"), lower=True):
                size, node, keys = [], [], []  # node: 128 bits that stand for the set
                for g in shingle_sets(w, n):
                    size.append(len(g))
                    node.append(mix(np.array([mix(g).sum(dtype=np.uint64), mix(g ^ U(0xABCDEF12345)).sum(dtype=np.uint64)], dtype=np.uint64) + U(len(g))).tobytes())
                    keys.append(block_keys(g, known.of(len(g))) if hot is None else prefix_keys(g, percent, [b.value for b in hot], MORE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").slice(a, b - a), batch.column("_key").slice(a, b - a), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in node], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["_doc", "_key", "n_shingles", "node", "c", "keys"],
                )

    return run


def _bitmap(keys: DataFrame) -> Broadcast:
    """A bit for each key; several keys may share one. At most MOST_BITS, so its size is bounded."""
    n = max(1 << 10, min(MOST_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    at = F.pmod("key", F.lit(n))
    words = keys.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(n // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _kept(bitmap: Broadcast):
    """The entries whose key has its bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat, row = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(keys)), pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64))
            keep = np.flatnonzero(has_bit(bitmap.value, flat))
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("c").take(take), batch.column("n_shingles").take(take), pa.array(flat[keep], pa.int64())], names=["c", "n_shingles", "key"])

    return run


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("_text"), lower=True):
                grams = pa.array([g.view(np.int64) for g in shingle_sets(w, n)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), batch.column("node").slice(a, b - a), grams], names=["c", "node", "grams"])

    return run


def _most_differ(a: Column, b: Column, percent: int) -> Column:
    return F.floor((100 - percent) * (a + b) / (100 + percent))


def _products(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The product of two rows of the incidence matrix for pairs (x, y): their sizes, overlap and nodes a and b."""
    x = rows.select(F.col("c").alias("x"), F.col("node").alias("a"), F.col("grams").alias("gx"))
    y = rows.select(F.col("c").alias("y"), F.col("node").alias("b"), F.col("grams").alias("gy"))
    both = pairs.join(x, "x").join(y, "y")
    return both.select("x", "y", "a", "b", F.size("gx").alias("nx"), F.size("gy").alias("ny"), F.size(F.array_intersect("gx", "gy")).alias("overlap"))


def _linked(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("nx") + F.col("ny") - F.col("overlap"))


def classes(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, text: str = "text", doc: str = "doc_id", columns: str = "blocks") -> DataFrame:
    """One row per row of `docs`: _doc, _key (of the text), n_shingles, node (of the n-gram set) and component (a node).
    columns: "blocks" compares rows that agree on a block of columns; "prefix" those that share one of the columns that
    decide, fewer keys where low thresholds ask for many blocks, and best where chance shares few n-grams. Both are exact."""
    base = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), text_key(F.col(text)).alias("_key"))
    kind = dict(base.dtypes)["_doc"]
    start = len(made())

    def keep(*paths: str) -> None:
        """Of the scratch tables made here only these are read again."""
        drop_scratch(docs.sparkSession, [p for p in made()[start:] if p not in paths])

    hot = None
    if columns == "prefix":
        counts = materialise(base.mapInArrow(_early(n, percent), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(HOT)), "join-counts", BATCH)
        hot = [_bitmap(counts.filter(F.col("n") > most)) for most in HOT]
    signed = materialise(base.mapInArrow(_signed(n, percent, hot), f"_doc {kind}, _key binary, n_shingles long, node binary, c long, keys array<long>"), "join-signed", BATCH)
    whole = made()[-1]
    slim = materialise(signed.drop("keys"), "join-slim")
    needed = made()[-1]
    # Keys that one row has can go. A bitmap of bounded size tells them: where it is full they stay, to go in the next step.
    again = materialise(signed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "join-again")
    entries = signed.select("c", "n_shingles", "keys").mapInArrow(_kept(_bitmap(again)), "c long, n_shingles long, key long")
    entries = materialise(entries.distinct(), "join-entries")
    drop_scratch(docs.sparkSession, [whole])
    # blocks that two nodes hold alike; the least node of a block is the hub that the others are compared with.
    # c is 64 bits of the node: candidates may go by it, since products and links are those of whole nodes
    shared = materialise(_met(entries), "join-blocks")
    for _ in range(2 if hot is not None else 0):  # what a node shares with all others together bounds what it shares with one
        enough = shared.groupBy("c", "n_shingles").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest_shared(F.col("n_shingles"), percent))
        shared = materialise(_met(shared.drop("hub").join(materialise(enough.select("c"), "join-enough"), "c", "left_semi")), "join-blocks")
    blocks = made()[-1]
    keep(needed, blocks)
    # the incidence rows of the nodes that are left
    left = shared.select("c").distinct()
    texts = materialise(slim.join(left, "c", "left_semi").groupBy("c", "node").agg(F.min("_key").alias("_key")), "join-left")
    if texts.count() <= BROADCAST_ROWS:
        near = base.join(F.broadcast(texts), "_key").groupBy("c", "node").agg(F.first("_text").alias("_text"))
    else:
        near = texts.join(base.groupBy("_key").agg(F.first("_text").alias("_text")), "_key").select("c", "node", "_text")
    near = materialise(near, "join-near")
    rows = materialise(near.mapInArrow(_grams(n), "c long, node binary, grams array<long>"), "join-rows", BATCH)
    keep(needed, blocks, made()[-1])
    names = rows.select("c", "node")
    # first the hub that a node meets most often, then its other hubs, then what is left between components
    met = materialise(shared.filter("c <> hub").groupBy("c", "hub").agg(F.count(F.lit(1)).alias("times")), "join-met")
    best = met.groupBy("c").agg(F.max(F.struct("times", "hub")).alias("b")).select(F.col("c").alias("x"), F.col("b.hub").alias("y"))
    first = materialise(_products(best, rows), "join-first")
    links = first.filter(_linked(percent)).select("a", "b")
    comp = components(links).join(names, "node")
    more = _apart(met.select(F.col("c").alias("x"), F.col("hub").alias("y")).join(best, ["x", "y"], "left_anti"), comp)
    second = materialise(_products(more, rows), "join-second")
    links = materialise(links.unionByName(second.filter(_linked(percent)).select("a", "b")), "join-links")
    comp = materialise(components(links).join(names, "node"), "join-components")
    groups = materialise(_groups(met), "join-groups")
    links = materialise(links.unionByName(_within(shared, comp, groups, rows, percent)), "join-links")
    comp = materialise(components(links).join(names, "node"), "join-components")
    third = materialise(_products(_across(shared, comp, groups, first.unionByName(second), percent), rows).filter(_linked(percent)), "join-third")
    if not third.isEmpty():
        comp = materialise(components(links.unionByName(third.select("a", "b"))), "join-components")
    out = slim.drop("c").join(comp.select("node", "component"), "node", "left")
    return out.withColumn("component", F.coalesce("component", "node"))


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose key two nodes have, with the least of these nodes as hub."""
    hubs = entries.groupBy("key").agg(F.min("c").alias("hub"), F.max("c").alias("other")).filter("hub <> other").drop("other")
    # written out, so that the join exchanges both sides and splits what is skewed
    return entries.join(materialise(hubs, "join-hubs"), "key").select("c", "n_shingles", "key", "hub")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (x, y) whose nodes are not known to be in one component."""
    cx = comp.select(F.col("c").alias("x"), F.col("component").alias("cx"))
    cy = comp.select(F.col("c").alias("y"), F.col("component").alias("cy"))
    d = pairs.join(cx, "x", "left").join(cy, "y", "left")
    return d.filter(F.coalesce(F.col("cx") != F.col("cy"), F.lit(True))).select("x", "y").distinct()


def _groups(met: DataFrame) -> DataFrame:
    """A group for each c: of the hubs that it meets, and itself if it is one, the hub that most meet."""
    popular = met.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    choice = met.select("c", "hub").join(popular, "hub").unionByName(popular.select(F.col("hub").alias("c"), "hub", "n"))
    return choice.groupBy("c").agg(F.max(F.struct("n", "hub")).alias("m")).select("c", F.col("m.hub").alias("group"))


def _mixed(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries of blocks that are not all in one component."""
    own = F.unhex(F.lpad(F.hex("c"), 16, "0"))
    d = shared.join(comp.select("c", "component"), "c", "left").withColumn("component", F.coalesce("component", own))
    apart = materialise(d.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("key"), "join-apart")
    return d.join(apart, "key", "left_semi")


def _within(shared: DataFrame, comp: DataFrame, groups: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between members of a group that are in different components, exactly, from what sets their rows apart from
    the group's centre (the n-grams that more than half have). With e(x) n-grams apart and w(x) = (100 + percent) e(x) -
    (100 - percent) |x|, x and y link if and only if w(x) + w(y) <= 2 (100 + percent) |apart(x) & apart(y)|. So who links
    with anybody without a common difference links with the member of least w; other links share differences, and rare
    ones among them."""
    since = len(made())
    nodes = _mixed(shared, comp).select("c", "component").distinct().join(groups, "c")
    sets = materialise(nodes.join(rows, "c").select("group", "node", "component", "grams"), "join-sets")
    sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    common = sets.select("group", F.explode("grams").alias("gram")).groupBy("group", "gram").agg(F.count(F.lit(1)).alias("n"))
    centre = materialise(common.join(sizes, "group").filter("2 * n > members").groupBy("group").agg(F.collect_list("gram").alias("centre")), "join-centres")
    d = sets.join(centre, "group", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    apart = F.concat(F.array_except("grams", "centre"), F.array_except("centre", "grams"))
    d = d.select("group", "node", "component", F.size("grams").alias("size"), apart.alias("apart"))
    d = settle(d.withColumn("w", (100 + percent) * F.size("apart") - (100 - percent) * F.col("size")), "join-differences", since)
    least = materialise(d.groupBy("group").agg(F.min(F.struct("w", "node")).alias("m"), F.max("size").alias("largest")), "join-least")
    star = d.join(least, "group").filter((F.col("node") != F.col("m.node")) & (F.col("w") + F.col("m.w") <= 0)).select(F.col("node").alias("a"), F.col("m.node").alias("b"))
    star = materialise(star, "join-star")
    # those that the star has put together need no pair any more
    held = least.select("group", F.col("m.w").alias("mw"), F.col("m.node").alias("mn"), "largest")
    d = d.join(held, "group").withColumn("component", F.when(F.col("w") + F.col("mw") <= 0, F.col("mn")).when(F.col("node") == F.col("mn"), F.col("mn")).otherwise(F.col("component"))).drop("mn")
    # Other links need at least `need` common differences, so all but need - 1 of the rarest of each node find them.
    d = materialise(d, "join-star-components")
    e = materialise(d.select("group", "node", F.explode("apart").alias("gram")), "join-apart-grams")
    shared_grams = materialise(e.groupBy("group", "gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "join-shared-grams")
    f = e.join(shared_grams, ["group", "gram"])
    # by the least w of a partner; and by its own differences, of which it must have as many as it shares
    partner = F.least("largest", F.floor(F.col("size") * 100 / percent))
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("mw")) / (2 * (100 + percent))), F.ceil((F.col("w") - (100 - percent) * partner) / (100 + percent)))
    held = d.select("group", "node", "component", "size", "w", need.alias("need"), F.size("apart").alias("all"))
    own = f.groupBy("group", "node").agg(F.count(F.lit(1)).alias("common"))
    rank = F.row_number().over(W.partitionBy("group", "node").orderBy("n", "gram"))
    f = f.withColumn("rank", rank).join(held.join(own, ["group", "node"]), ["group", "node"])
    f = f.filter((F.col("need") <= F.col("common")) & (F.col("rank") + F.col("all") - F.col("common") <= F.col("all") - F.col("need") + 1))
    f = materialise(f.select("group", "gram", "node", "component", "size", "w", "rank", "common"), "join-rare")
    x, y = f.toDF("group", "gram", "a", "cx", "sx", "wx", "rx", "nx"), f.toDF("group", "gram", "b", "cy", "sy", "wy", "ry", "ny")
    # what can be common before this difference, with it and after it
    most = F.least("rx", "ry") + F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))
    enough = F.col("wx") + F.col("wy") <= 2 * (100 + percent) * most
    sized = 100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy")
    pairs = x.join(y, ["group", "gram"]).filter((F.col("a") < F.col("b")) & (F.col("cx") != F.col("cy")) & sized & enough).groupBy("a", "b").agg(F.first("wx").alias("wx"), F.first("wy").alias("wy"))
    both = pairs.join(d.select(F.col("node").alias("a"), F.col("apart").alias("dx")), "a").join(d.select(F.col("node").alias("b"), F.col("apart").alias("dy")), "b")
    links = both.filter(F.col("wx") + F.col("wy") <= 2 * (100 + percent) * F.size(F.array_intersect("dx", "dy")))
    return star.unionByName(links.select("a", "b"))


def _across(shared: DataFrame, comp: DataFrame, groups: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups that agree on a block, are in different components and that no bound rules out."""
    far = known.select(F.col("x").alias("c"), F.col("y").alias("hub"), (F.col("nx") + F.col("ny") - 2 * F.col("overlap")).alias("far"))
    # without a measured distance to the hub (the two are in one component) only the other bounds hold
    d = _mixed(shared, comp).join(groups, "c").filter("c <> hub").join(far, ["c", "hub"], "left")
    d = materialise(d.select("key", "c", "n_shingles", "component", "far", "group"), "join-mixed")
    several = materialise(d.groupBy("key").agg(F.min("group").alias("g1"), F.max("group").alias("g2")).filter("g1 <> g2").select("key"), "join-several")
    d = d.join(several, "key", "left_semi")
    d = materialise(d.select("key", "c", "n_shingles", "component", "far", "group"), "join-across")
    x, y = d.toDF("key", "x", "sx", "cx", "fx", "gx"), d.toDF("key", "y", "sy", "cy", "fy", "gy")
    near = F.coalesce(F.abs(F.col("fx") - F.col("fy")) <= _most_differ(F.col("sx"), F.col("sy"), percent), F.lit(True))
    sized = 100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy")
    return x.join(y, "key").filter((F.col("x") < F.col("y")) & (F.col("gx") != F.col("gy")) & (F.col("cx") != F.col("cy")) & sized & near).select("x", "y").distinct()


def join_documents(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach; one row per row of `docs`."""
    since = len(made())
    found = settle(classes(docs, n, percent), "join-classes", since)
    least = found.groupBy("component").agg(F.min("_doc").alias("component_id"))
    # a set without n-grams links with nothing, not even with its like
    out = found.join(least, "component")
    return out.select(F.col("_doc").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("_doc")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the least doc_id (then text); documents without n-grams all stay. Columns as in `docs`."""
    since = len(made())
    found = settle(classes(docs, n, percent, columns="prefix"), "join-classes", since)
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_key")).alias("m")).select(F.col("m._doc").alias("_d"), F.col("m._key").alias("_k"))
    row, key, no = (free_name(docs.columns, c) for c in ("_row", "_k", "_no"))
    d = docs.select(F.struct(*docs.columns).alias(row), text_key(F.col("text")).alias(key), F.col("doc_id").alias("_d2"))
    empty = found.filter("n_shingles = 0").select(F.col("_key").alias(key)).distinct()
    single = d.join(first.select(F.col("_d").alias("_d1"), F.col("_k").alias(key)), key).filter(F.col("_d1").eqNullSafe(F.col("_d2"))).drop("_d1")
    single = single.groupBy(key, "_d2").agg(F.first(row).alias(row))  # of repeated rows one
    return single.select(f"{row}.*").unionByName(d.join(broadcast_small(empty, BROADCAST_ROWS), key, "left_semi").select(f"{row}.*"))
