"""Byte-level BPE against the tiktoken library and against plain merging."""

import random

import numpy as np
import pytest
import tiktoken

from hirelake.llm import byte_bpe


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.vocabulary_file(), byte_bpe.public_pattern())


@pytest.fixture(scope="module")
def known(vocabulary):
    return tiktoken.Encoding("known", pat_str=byte_bpe.public_pattern(), mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids(known, text):
    return np.array(known.encode_ordinary(text or ""), "<u4").tobytes()


def texts():
    rnd = random.Random(11)
    words = ["the", "of", "'re", "don't", "naïve", "日本語", "🙂", "123", "4,5", "...", "\n\n", "\t", "x" * 30, "re'realm", "<|endoftext|>"]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice(["", " ", "  ", "\n", " \n "]) for _ in range(n))
    out = [make(rnd.randint(1, 400)) for _ in range(60)]
    out += [None, "", " ", "   ", "a", "'", "a" * 700, " " * 500, "!" * 333, "ab " * 300, "a" * 100 + " b" * 100 + "c" * 300, "'ll" * 200, "é" * 301, "​ \x1c\x85 x" * 40]
    return out


def test_all_characters(vocabulary, known):
    for start in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)} {chr(c)}" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert vocabulary.encode(text) == ids(known, text)


def test_long_pre_tokens(vocabulary):
    rnd = random.Random(3)
    for text in ("a" * 3001, "ab" * 1500, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), "".join(rnd.choices("ABCabc019+/", k=3000)), "é" * 999, "-=" * 700 + "=" * 801):
        assert vocabulary._merge_long(text.encode()) == vocabulary._merge_short(text.encode()) == vocabulary.merged(text.encode())


def test_boundaries_hold(vocabulary):
    """What a cut text counts as sure are boundaries of the whole one."""
    whole = "".join(t or "" for t in texts())[:6000]
    true = set(byte_bpe.boundaries(whole, vocabulary.pattern, True).tolist())
    for end in range(5500, 6000):
        assert set(byte_bpe.boundaries(whole[:end], vocabulary.pattern, False).tolist()) <= true


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (40, 12), (7, 3)])
def test_encode(spark, known, chunk, overlap):
    rows = [(i, t, "own") for i, t in enumerate(texts())]
    rows += [(None, "no id " * 30, None), (900, "copy of this " * 40, "x"), (900, "copy of this " * 40, "x"), (901, "copy of this " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    coded = byte_bpe.decode(byte_bpe.encode(docs, chunk=chunk, overlap=overlap), "ids_")
    assert coded.columns == ["doc_id", "text", "ids", "ids_", "decoded"]
    got = sorted(((r["doc_id"] or -1, r["text"] or "", r["ids"] or "", bytes(r["ids_"]), bytes(r["decoded"]))) for r in coded.collect())
    assert got == sorted((d or -1, t or "", own or "", ids(known, t), (t or "").encode()) for d, t, own in rows)


def test_empty(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
