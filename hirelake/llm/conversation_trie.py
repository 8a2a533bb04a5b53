"""The trie of shared conversation prefixes, with sums over subtrees from an Euler tour.

A node is a distinct sequence of first turns. A turn is told apart by 128 bits of SHA-256 of its role and text, a prefix by
the exclusive or of its turns' bits mixed with their depth, 2 times 64 bits, so that prefixes are sums over positions and a
conversation of any length is summed in blocks of depths.

Every node has an arc that enters it and one that leaves it. The arc after an entry is the first child's entry, or the
node's own exit; after an exit comes the next sibling's entry, or the parent's exit. This list of arcs is ranked
distributedly: arcs are numbered by the conversation that first has their node, so neighbours in the list mostly lie
in the same range of numbers. Each range walks its arcs and leaves a fragment for every run that stays within it;
fragments are a shorter list of the same kind, over ranges FAN times as wide, until one is left. If a range has more
than MOST of them, rounds of coin flips splice arcs out by joins first, which shortens any list. Places of fragments then
give the places of arcs. A node's leaves and savings are differences of prefix sums at its two arcs; prefix sums are
taken in blocks of places.

Turns are numbered by an exchange into ranges of conversation and turn, siblings and digests by ranges too, so neither a
conversation with a third of all turns nor a node with a third of all children meets in one task. (A SHA-256 of a list
of ids can't be split: its text goes through one task, in blocks of BLOCK_BYTES, as a stream.)

Turns of a null conv_id are left out. Null roles and texts count as empty. Turns of a conversation with the same number are
ordered by the digest of role and text; equal rows are turns each. Other columns than the four don't matter. An
empty table gives no nodes, not even a root. Texts have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, n_words

FAMILY = 20  # conversations that take their first turns from the first of them
MOST_TAKEN = 4
DEPTHS = 4_096  # turns of a conversation that are summed at a time
SIBLINGS = 16  # bits: siblings that are looked at together
PLACES = 18  # bits: arcs that are summed at a time
FAN = 4  # bits: ranges that become one in the next round of list ranking
MOST = 1_000_000  # arcs that a task walks
BLOCK_BYTES = 1 << 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their digest, words and place in sorted ranges; and for each conversation and range, how many it has there and before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    d = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", half(1).alias("d1"), half(17).alias("d2"), n_words(text).alias("words"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2"), F.col("_row")]
    placed = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "d1", "d2", "words", F.monotonically_increasing_id().alias("_at"))
    placed = materialise(placed, "trie-turns").withColumn("_part", F.shiftright("_at", 33))
    spans = placed.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    of = W.partitionBy("conv_id")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed, spans.select("conv_id", "_part", "_low", before.alias("_before"), F.sum("_n").over(of).alias("n_own"))


def fork(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns taken from the first of its family of FAMILY: as many as the CRC-32 of its id says,
    from 0 to MOST_TAKEN - 1, or all where there are fewer; then its own turns after that many. Gives turns (conv_id, depth
    from 1, d1, d2, words, last: whether it is the last one) and conversations (conv_id, n_turns)."""
    placed, spans = _numbered(conversations)
    spans = materialise(spans, "trie-spans")
    convs = spans.filter("_before = 0").select("conv_id", "n_own")
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_TAKEN
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = convs.select(F.col("conv_id").alias("_base"), F.col("n_own").alias("_n_base"))
    info = convs.select("conv_id", "n_own", skip.alias("_skip"), base.alias("_base")).join(first, "_base", "left")
    info = info.withColumn("_taken", F.least("_skip", F.coalesce("_n_base", F.lit(0))))
    info = info.withColumn("n_turns", F.col("_taken") + F.greatest(F.col("n_own") - F.col("_skip"), F.lit(0)))
    info = materialise(info.select("conv_id", "_base", "_skip", "_taken", "n_turns"), "trie-convs")
    where = spans.drop("n_own").join(info.drop("_base"), "conv_id")
    pos = F.col("_before") + F.col("_at") - F.col("_low") + 1
    turns = placed.join(where, ["conv_id", "_part"]).withColumn("pos", pos)
    own = turns.filter(F.col("pos") > F.col("_skip")).select("conv_id", (F.col("_taken") + F.col("pos") - F.col("_skip")).alias("depth"), "d1", "d2", "words", "n_turns")
    lent = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_TAKEN)).select(F.col("conv_id").alias("_base"), F.col("pos").alias("depth"), "d1", "d2", "words")
    taken = info.filter("_taken > 0").join(lent, "_base").filter(F.col("depth") <= F.col("_taken")).select("conv_id", "depth", "d1", "d2", "words", "n_turns")
    return own.unionByName(taken).withColumn("last", F.col("depth") == F.col("n_turns")).drop("n_turns"), info.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, last, the prefix that ends with the turn (k1, k2) and the one before it (p1, p2)."""
    block = F.floor((F.col("depth") - 1) / DEPTHS)
    d = turns.select("conv_id", "depth", "words", "last", block.alias("_block"), F.xxhash64("d1", "d2", "depth").alias("t1"), F.xxhash64("depth", "d2", "d1", F.lit(13)).alias("t2"))
    inside = W.partitionBy("conv_id", "_block").orderBy("depth")
    totals = d.groupBy("conv_id", "_block").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    earlier = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "_block", *(F.bit_xor(c).over(earlier).alias(f"_{c}") for c in ("t1", "t2"))).filter("_block > 0")
    d = d.withColumns({f"x{i}": F.bit_xor(f"t{i}").over(inside) for i in (1, 2)}).join(totals, ["conv_id", "_block"], "left")
    key = {i: F.col(f"x{i}").bitwiseXOR(F.coalesce(F.col(f"_t{i}"), F.lit(0))) for i in (1, 2)}
    return d.select("conv_id", "depth", "words", "last", *(key[i].alias(f"k{i}") for i in (1, 2)), *(key[i].bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node, joined, from rows sorted by node and id; several rows where they are long or in several ranges."""
    now, ids, size, out = None, [], 0, []

    def put():
        out.append((*now, ids[0], ",".join(map(str, ids))))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k1", "k2", "depth", "_first", "_ids"])

    for b in batches:
        for key in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "depth", "conv_id")), strict=True):
            if key[:3] != now or size > BLOCK_BYTES:
                if now is not None:
                    put()
                now, ids, size = key[:3], [], 0
            ids.append(key[3])
            size += 12
        yield batch()
        out.clear()
    if now is not None:
        put()
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, out = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["k1", "k2", "depth", "ends_sha256"])

    for b in batches:
        for *key, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "depth", "_ids")), strict=True):
            if key != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield batch()
        out.clear()
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield batch()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids, ascending and joined by commas, of the conversations that end at a node (k1, k2, depth)."""
    node = ["k1", "k2", "depth"]
    sorted_ = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    blocks = sorted_.mapInArrow(_blocks, "k1 long, k2 long, depth long, _first long, _ids string")
    return blocks.repartition(*node).sortWithinPartitions(*node, "_first").mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")


def _walk(rows: pa.Table) -> pa.Table:
    """The runs of a list within one range: for each arc the first arc of its run and the weight before it in the run; for
    first arcs what comes after the run, and its weight."""
    ids, after, weight = (rows[c].to_numpy() for c in ("id", "next", "weight"))
    order = np.argsort(ids)
    ids, after, weight = ids[order], after[order], weight[order].tolist()
    at = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    inside = ids[at] == after
    first = np.ones(len(ids), bool)
    first[at[inside]] = False
    following = np.where(inside, at, -1).tolist()
    run, place = [0] * len(ids), [0] * len(ids)
    onward, total = [None] * len(ids), [None] * len(ids)
    for start in np.flatnonzero(first).tolist():
        i, done = start, 0
        while True:
            run[i], place[i] = start, done
            done += weight[i]
            if following[i] < 0:
                break
            i = following[i]
        onward[start], total[start] = int(after[i]), done
    return pa.table({"id": ids, "run": ids[np.array(run, np.int64)], "at": pa.array(place, pa.int64()), "next": pa.array(onward, pa.int64()), "weight": pa.array(total, pa.int64())})


_RUNS = "id long, run long, at long, next long, weight long"


def _spliced(arcs: DataFrame, salt: int) -> DataFrame:
    """One round of coin flips: an arc with 1 whose predecessor has 0 joins the run of that one. Columns as of _walk."""
    coin = lambda c: F.xxhash64(c, F.lit(salt)).bitwiseAND(F.lit(1))
    gone = arcs.filter(coin(F.col("id")) == 1).select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("weight").alias("_weight"))
    pairs = arcs.join(gone, (F.col("next") == F.col("_id")) & (coin(F.col("id")) == 0), "left")
    pairs = materialise(pairs, "trie-splice")
    joined = pairs.filter(F.col("_id").isNotNull())
    removed = joined.select(F.col("_id").alias("id"), F.col("id").alias("run"), F.col("weight").alias("at"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("weight"))
    rest = pairs.join(removed.select("id"), "id", "left_anti")
    kept = rest.select("id", F.col("id").alias("run"), F.lit(0).cast("long").alias("at"), F.coalesce("_next", "next").alias("next"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"))
    return kept.unionByName(removed)


def rank_list(arcs: DataFrame, block_bits: int, fan: int = FAN, most: int = MOST) -> DataFrame:
    """id and place (from 0) of a list of arcs (id, next; the last one's next is negative). Arcs whose ids agree but for the last
    `block_bits` bits are walked together at first."""
    levels, now, bits, salt = [], arcs.withColumn("weight", F.lit(1).cast("long")), block_bits, 0
    while True:
        block = F.shiftright("id", min(bits, 63))
        if levels:
            while now.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] > most:
                level = materialise(_spliced(now, salt), "trie-runs")
                levels.append(level)
                now, salt = level.filter("id = run").select("id", "next", "weight"), salt + 1
        level = materialise(now.groupBy(block.alias("_b")).applyInArrow(_walk, _RUNS), "trie-runs")
        levels.append(level)
        now = level.filter("id = run").select("id", "next", "weight")
        if now.limit(2).count() < 2:
            break
        bits += fan
    places = levels.pop().select("id", F.col("at").alias("place"))
    for level in reversed(levels):
        known = places.select(F.col("id").alias("run"), F.col("place").alias("_start"))
        places = level.select("id", "run", "at").join(known, "run").select("id", (F.col("_start") + F.col("at")).alias("place"))
    return places


def _linked(nodes: DataFrame, root_id: int, root_conv: int) -> DataFrame:
    """nodes with `parent` and parent_conv_id. The root's children, which may be very many, are not joined."""
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(parents, ["p1", "p2", "depth"]).drop("p1", "p2")
    of_root = nodes.filter("depth <= 1").drop("p1", "p2")
    top = lambda v: F.when(F.col("depth") == 1, F.lit(v).cast("long"))
    return deep.unionByName(of_root.withColumns({"parent": top(root_id), "parent_conv_id": top(root_conv)}))


def _tour(nodes: DataFrame) -> DataFrame:
    """nodes with n_children and the arcs after their two arcs; the entry of node n is 2 n, its exit 2 n + 1."""
    kids = nodes.filter(F.col("parent").isNotNull()).select("parent", "nid", F.shiftright("nid", SIBLINGS).alias("_b"))
    heads = kids.groupBy("parent", "_b").agg(F.min("nid").alias("_head"), F.count(F.lit(1)).alias("_n"))
    heads = materialise(heads, "trie-siblings")
    then = heads.select("parent", "_b", F.lead("_head").over(W.partitionBy("parent").orderBy("_b")).alias("_then")).filter(F.col("_then").isNotNull())
    beside = F.lead("nid").over(W.partitionBy("parent", "_b").orderBy("nid"))
    sibling = kids.withColumn("_beside", beside).join(then, ["parent", "_b"], "left").select("nid", F.coalesce("_beside", "_then").alias("_sibling"))
    first = heads.groupBy(F.col("parent").alias("nid")).agg(F.min("_head").alias("_child"), F.sum("_n").alias("n_children"))
    d = nodes.join(first, "nid", "left").join(sibling, "nid", "left")
    own, up = F.col("nid") * 2, F.coalesce(F.col("parent") * 2 + 1, F.lit(-1))
    return d.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "_after_entry": F.coalesce(F.col("_child") * 2, own + 1), "_after_exit": F.coalesce(F.col("_sibling") * 2, up)}).drop("_child", "_sibling", "parent")


def _subtrees(tour: DataFrame, places: DataFrame) -> DataFrame:
    """nid, n_leaves and saved_tokens from prefix sums over the places of the arcs."""
    own = tour.select("nid", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    entry = F.col("id") % 2 == 0
    d = places.select(F.shiftright("id", 1).alias("nid"), entry.alias("entry"), "place").join(own, "nid")
    here = lambda c: F.when(F.col("entry"), F.col(c)).otherwise(0)
    d = d.select("nid", "entry", "place", here("leaf").alias("leaf"), here("saved").alias("saved"), F.shiftright("place", PLACES).alias("_b"))
    d = materialise(d, "trie-places")
    totals = d.groupBy("_b").agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row for each 2 ** PLACES arcs
    totals = totals.select("_b", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_leaf", "_saved")))
    inside = W.partitionBy("_b").orderBy("place")
    d = d.select("nid", "entry", "_b", "leaf", "saved", F.sum("leaf").over(inside).alias("l"), F.sum("saved").over(inside).alias("s")).join(totals, "_b")
    # the sum up to the exit, without what comes before the entry
    part = lambda c, x, before: F.sum(F.when(F.col("entry"), F.col(c) - F.col(x) - F.col(before)).otherwise(F.col(x) + F.col(before)))
    return d.groupBy("nid").agg(part("leaf", "l", "_leaf").alias("n_leaves"), part("saved", "s", "_saved").alias("saved_tokens"))


def trie(turns: DataFrame, conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, depth, d1, d2, words, last) of `conversations` (conv_id, n_turns): NODES."""
    spark = turns.sparkSession
    root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODES)
    found = materialise(prefixes(turns), "trie-prefixes")
    nodes = found.groupBy("k1", "k2", "depth").agg(F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "words")))
    top = spark.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth")), F.lit(root["n"]).cast("long").alias("n_convs"), F.lit(root["conv_id"]).cast("long").alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "words")))
    placed = nodes.unionByName(top).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    nodes = materialise(placed.withColumn("nid", F.monotonically_increasing_id()), "trie-nodes")
    root_id = nodes.filter("depth = 0").first()["nid"]
    tour = materialise(_tour(materialise(_linked(nodes, root_id, root["conv_id"]), "trie-links")), "trie-tour")
    arcs = tour.select(F.explode(F.array(F.struct((F.col("nid") * 2).alias("id"), F.col("_after_entry").alias("next")), F.struct((F.col("nid") * 2 + 1).alias("id"), F.col("_after_exit").alias("next")))).alias("a")).select("a.*")
    sums = _subtrees(tour, rank_list(arcs, 34, most=most))
    ends = found.filter("last").select("k1", "k2", "depth", "conv_id").unionByName(conversations.filter("n_turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth")), "conv_id"))
    out = tour.join(sums, "nid").join(end_digests(ends), ["k1", "k2", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def forked_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations, forked."""
    return trie(*fork(conversations))

