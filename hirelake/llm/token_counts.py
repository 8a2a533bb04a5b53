"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Pre-tokens go into a trie. Each node holds the best forward score of its prefix, the number of tokens on that best
path and its last piece, computed once however many pre-tokens share the prefix; a pre-token's count is stored at its
terminal, and a document adds up the terminals of its words. Pieces that end at a character are found by walking a trie
of the reversed pieces backwards, so that only suffixes that lead to a piece are tried.

The distinct pre-tokens of the corpus are counted once, exactly. Those that come often (COMMON at most, whatever the
corpus) get their terminals once and are sent to all tasks; the others, which few tasks have, are worked out where
they are met. Words of documents are not shuffled.

The pieces come from a public vocabulary file and stay as they are. Their unigram log probabilities are a language model
of the corpus: ROUNDS rounds of expectation-maximisation over all distinct pre-tokens and their exact counts, each of
which counts the pieces on best paths (whole numbers, so that reruns agree), from a start by rank; every piece counts
once more than seen. A character that no piece holds scores 10 less than the worst piece and counts as its UTF-8 bytes.
Of equal scores the longer last piece wins.

A pre-token of over LONG characters is not put into the trie: its forward scores are worked out in a window as long as
the longest piece, and of it only its count is kept, so a run of any length takes a few times its own bytes. The result
is the same.

Pre-tokens are runs of other than blanks and U+0009 to U+000D, led by U+2581. Null and blank texts have 0 words and 0
tokens; rows are judged alone once the scores are known; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAD = "▁"
ROUNDS = 2
COMMON = 300_000  # pre-tokens whose terminals go to all tasks
CACHED = 300_000  # terminals and nodes that a task keeps
SLICE_ROWS = 500
LONG = 256  # characters of a pre-token that share nodes with others
MOST_COUNTED = 200_000  # pre-tokens that a task counts before it passes them on


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a vocabulary file, best rank first."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in ids]


def start_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities to start from: one over the rank."""
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


def fitted_scores(pieces: list[str], counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values()) + len(pieces)
    return {p: math.log((counts.get(p, 0) + 1) / total) for p in pieces}


class ForwardTrie:
    """The trie of pre-tokens. A node is [best score, tokens, characters of the last piece (0: unknown), children or None]."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - 10
        self.single = {p for p in scores if len(p) == 1}
        self.longest = max(map(len, scores), default=1)
        self.reversed: dict = {}  # children by character going backwards, and the score of the piece that ends there by ""
        for piece, score in scores.items():
            node = self.reversed
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.reset()

    def reset(self) -> None:
        self.root, self.nodes = [0.0, 0, 0, None], 0

    def walk(self, word: bytes) -> tuple[str, list[int], int]:
        """(text, size of the last piece of each prefix, tokens) of a pre-token; new prefixes become nodes."""
        if self.nodes > CACHED:
            self.reset()
        text, node = LEAD + word.decode("utf-8", "replace"), self.root
        best, tokens, sizes = [0.0], [0], [0]
        for end, c in enumerate(text, 1):
            children = node[3]
            child = children.get(c) if children is not None else None
            if child is None:
                # the best score of this prefix from those of shorter ones
                top, count, size, at, back = -math.inf, 0, 0, end, self.reversed
                while at:
                    at -= 1
                    back = back.get(text[at])
                    if back is None:
                        break
                    score = back.get("")
                    if score is not None and best[at] + score >= top:  # a longer piece comes later and wins a tie
                        top, count, size = best[at] + score, tokens[at] + 1, end - at
                if c not in self.single and best[end - 1] + self.unknown > top:
                    top, count, size = best[end - 1] + self.unknown, tokens[end - 1] + len(c.encode("utf-8", "replace")), 0
                child = [top, count, size, None]
                if children is None:
                    node[3] = {c: child}
                else:
                    children[c] = child
                self.nodes += 1
            best.append(child[0])
            tokens.append(child[1])
            sizes.append(child[2])
            node = child
        return text, sizes, tokens[-1]

    def slide(self, word: bytes) -> tuple[str, array, int]:
        """The same as walk() without nodes: scores and tokens of as many prefixes as the longest piece has characters, in
        turn in the same places. Sizes are kept, a byte or two for each character."""
        text, turn = LEAD + word.decode("utf-8", "replace"), self.longest + 1
        best, tokens = [0.0] * turn, [0] * turn
        sizes = array("B" if self.longest < 256 else "I", bytes(1 if self.longest < 256 else 4))
        for end, c in enumerate(text, 1):
            top, count, size, at, back = -math.inf, 0, 0, end, self.reversed
            while at:
                at -= 1
                back = back.get(text[at])
                if back is None:
                    break
                score = back.get("")
                if score is not None and best[at % turn] + score >= top:
                    top, count, size = best[at % turn] + score, tokens[at % turn] + 1, end - at
            if c not in self.single and best[(end - 1) % turn] + self.unknown > top:
                top, count, size = best[(end - 1) % turn] + self.unknown, tokens[(end - 1) % turn] + len(c.encode("utf-8", "replace")), 0
            best[end % turn], tokens[end % turn] = top, count
            sizes.append(size)
        return text, sizes, tokens[len(text) % turn]

    def scored(self, word: bytes) -> tuple[str, Sequence[int], int]:
        return self.walk(word) if len(word) <= LONG else self.slide(word)

    def count(self, word: bytes) -> int:
        return self.scored(word)[2]

    def pieces(self, word: bytes) -> Iterator[str]:
        """The pieces on the best path, from the end; unknown characters are none."""
        text, sizes, _ = self.scored(word)
        end = len(text)
        while end:
            if sizes[end]:
                yield text[end - sizes[end] : end]
            end -= sizes[end] or 1


def _words(column: pa.Array) -> list[list[bytes]]:
    return [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in column]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens and how often they come, several times where a task has many."""

    def passed_on(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

    counted: Counter = Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for words in _words(batch.column("text").slice(at, SLICE_ROWS)):
                counted.update(words)
            if len(counted) > MOST_COUNTED:
                yield passed_on(counted)
                counted = Counter()
    yield passed_on(counted)


@contextmanager
def _no_cycles():
    """Without the collector of cycles, of which a trie has none, but many nodes that it would look at again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _expected(scores: dict[str, float]):
    """The pieces on the best paths of pre-tokens, with the counts of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, found = ForwardTrie(scores), Counter()
        for batch in batches:
            with _no_cycles():
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for piece in trie.pieces(word):
                        found[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    return run


def _terminals(scores: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(scores)
        for batch in batches:
            words = batch.column("word")
            with _no_cycles():
                tokens = [trie.count(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(tokens, pa.int64())], names=["word", "tokens"])

    return run


def _counter(scores: dict[str, float], common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = ForwardTrie(scores), dict(common.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = _words(batch.column("text"))
                if len(known) > len(common.value) + CACHED:
                    known = dict(common.value)
                with _no_cycles():
                    for w in sorted({w for words in texts for w in words} - known.keys()):  # sorted, so that neighbours share prefixes
                        known[w] = trie.count(w)
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([sum(map(get, words)) for words in texts], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def distinct_words(docs: DataFrame) -> DataFrame:
    """word (bytes) and n, each word once; sorted in each part, so that neighbours share prefixes."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_distinct, "word binary, n long")
    return materialise(found.groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word"), "token-words")


def fit(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Log probabilities of the pieces. words: word and n. One row a piece goes to the driver."""
    scores = start_scores(pieces)
    for _ in range(rounds):
        found = words.mapInArrow(_expected(scores), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        scores = fitted_scores(pieces, {r["piece"]: r["n"] for r in found.collect()})
    return scores


def _common(words: DataFrame, scores: dict[str, float], most: int) -> dict[bytes, int]:
    """The terminals of the pre-tokens that come twice or more, and so often that there are at most `most` of them."""
    left, least = most, None
    # there are few different counts: one of k takes k words, so N words have fewer than sqrt(2 N)
    for r in words.filter("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).toLocalIterator():
        left -= r["words"]
        if left < 0:
            break
        least = r["n"]
    if least is None:
        return {}
    found = words.filter(F.col("n") >= least).mapInArrow(_terminals(scores), "word binary, tokens long").toArrow()
    return dict(zip(found["word"].to_pylist(), found["tokens"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words and n_tokens, one row per row of `docs`. The file is read once, on the driver."""
    words = distinct_words(docs)
    scores = fit(words, load_pieces(vocabulary), rounds)
    common = docs.sparkSession.sparkContext.broadcast(_common(words, scores, COMMON))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(_counter(scores, common), f"doc_id {kind}, n_words long, n_tokens long")
