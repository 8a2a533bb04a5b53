"""The prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hirelake.llm import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            halves = [int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8)]
            own[c].append((turn is not None, turn or 0, halves, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own_saved = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = own_saved + sum(saved[x] for x in children[k])
    out = []
    for k, m in members.items():
        e = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], e))
    return sorted(out)


def got(df):
    names = [x.split()[0] for x in conversation_trie.NODES.split(", ")]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    words = ["yes", "no", "why", "tell me", " a  b ", "", None, "naïve été"]
    out = []
    for c in [*range(0, 130), 200, 205, 219, 1_000_003, *range(400, 460, 7)]:
        if c in (40, 41, 60):  # without the first of a family
            continue
        turns = [(c, t, "user" if t % 2 else None, rnd.choice(words)) for t in range(rnd.choice([0, 1, 1, 2, 3, 4, 5, 9]))]
        out += turns
    out += [(7, None, "system", "x y"), (7, None, "system", "a"), (8, 0, "user", "same"), (8, 0, "user", "same"), (None, 0, "user", "nobody"), (80, 3, "", "tie one"), (80, 3, "", "tie two")]
    out += [(300, t, "user", f"turn {t % 5}") for t in range(60)] + [(301, t, "user", f"turn {t % 5}") for t in range(60)]
    out += [(500 + i, t, "user", "the same first words") for i in range(80) for t in range(1)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, rows, small, monkeypatch):
    """small: with every block, range and walk so small that all their borders are met."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    if small:
        monkeypatch.setattr(conversation_trie, "DEPTHS", 3)
        monkeypatch.setattr(conversation_trie, "SIBLINGS", 2)
        monkeypatch.setattr(conversation_trie, "PLACES", 5)
        monkeypatch.setattr(conversation_trie, "BLOCK_BYTES", 100)
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3)
        df = conversation_trie.trie(*conversation_trie.fork(docs), most=30 if small else conversation_trie.MOST)
        assert got(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_rank_list(spark, most):
    """A list in no order at all: coin flips shorten it until a task may walk it."""
    ids = list(range(0, 900, 3))
    random.Random(4).shuffle(ids)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], -1], strict=True)), "id long, next long").repartition(5)
    places = {r["id"]: r["place"] for r in conversation_trie.rank_list(arcs, 5, 2, most).collect()}
    assert places == {x: i for i, x in enumerate(ids)}


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert conversation_trie.forked_trie(make([])).count() == 0
    assert conversation_trie.forked_trie(make([(None, 1, "user", "x")])).count() == 0
    for rows in ([(0, 0, None, None)], [(5, 0, "user", "a b")]):  # the second has no turn left: 5 takes over all it has
        assert got(conversation_trie.forked_trie(make(rows))) == plain(rows)
    assert conversation_trie.forked_trie(make([(3, 0, "a", "b")]).withColumn("k1", F.lit("mine"))).count() >= 1
