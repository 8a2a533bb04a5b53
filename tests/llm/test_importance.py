"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hirelake.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, rank string"


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target):
    s, t = Counter(), Counter()
    for text in target:
        t.update(plain_features(text)[1])
    found = [(d, *plain_features(text)) for d, text in rows]
    for _, _, f in found:
        s.update(f)
    S, T = float(sum(s.values())), float(sum(t.values()))
    out = []
    for d, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = able[: 5 * len(able) // 100]
    got = Counter((*x[:1], *x[2:], None) for x in out)
    for i, x in enumerate(drawn):
        got[(x[0], *x[2:], None)] -= 1
        got[(x[0], *x[2:], i + 1)] += 1
    return +got


def test_scan_and_pack():
    for text in ("", " ", "a", "A b", "Élan é 3 x-y", "one two three four", "ａ\x85b c", "x" * 5000 + " y", "w " * 400):
        n, want = plain_features(text)
        words, got = importance.scan(text.encode())
        assert words == n and sorted(got.tolist()) == sorted(want)
        assert importance.unpack(importance.pack(got)).tolist() == sorted(want)
    gaps = np.array([0, 255, 510, 9999, 9999, 254], np.uint32)
    assert importance.unpack(importance.pack(gaps)).tolist() == sorted(gaps.tolist())


@pytest.mark.parametrize("scanned", [100_000, 7])
def test_scores(spark, scanned, monkeypatch):
    monkeypatch.setattr(importance, "SCANNED", scanned)
    rnd = np.random.default_rng(3)
    vocabulary = ["the", "Of", "naïve", "été", "3rd", *(f"w{i}" for i in range(200))]
    make = lambda n: " ".join(rnd.choice(vocabulary, n))
    rows = [(i, make(int(rnd.integers(1, 120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n.;"), (203, "x " * 5000), (204, make(30) + "\n- " + make(20)), (None, make(40)), (None, None)]
    rows += [(300, make(25))] * 3 + [(301 + i, "same text " * 15) for i in range(5)]
    target = [make(60), None, "", "same text here", make(200)]
    docs = spark.createDataFrame([(d, t, "s", "own") for d, t in rows], SCHEMA).repartition(4)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.score_documents(docs, goal)
    assert got.columns == ["doc_id", "text", "source", "rank", "n_features", "weight", "score", "rank_"]
    want = plain(rows, target)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank_").collect()) == want
    drawn = importance.resample(docs, goal)
    assert drawn.columns == docs.columns and drawn.count() == sum(n for k, n in want.items() if k[-1])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.score_documents(none, some).count() == 0
    assert [tuple(r)[2:] for r in importance.score_documents(some, none).collect()] == [tuple(r)[2:] for r in importance.score_documents(some, none).collect()]
    assert importance.score_documents(some, none, percent=100).first()["rank"] == 1
