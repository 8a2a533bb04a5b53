"""Substring dedup by super-k-mers of words: every word in a 35-word window that occurs elsewhere goes.

A window's minimiser is the 8-word run of least hash in it. Consecutive windows that share one travel as
one packed string to the bucket of their minimiser, so equal windows always meet, and each bucket sorts
its windows and counts them by their words, not by hashes. Minimisers that occur once in the corpus
cannot be in a repeated window; counts of minimisers alone, 8 bytes each, rule those strings out before
any text moves. A minimiser with very many strings (a passage in a large part of the corpus) is not put
in one bucket: its distinct strings are counted with partial sums first, then the windows of each distinct
string, and what is repeated in a string goes back to all its places.

Equal texts are one text with a count: with two copies and 35 words all of it is repeated. Windows are
judged on the input. Words are runs of other than blanks and U+0009 to U+000D. Null texts, and texts under
35 words, have no windows and lose nothing; their kept text is their words. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, text_key
from hirelake.llm.tokens import U, Words, mix, slices

WINDOW = 35
RUN = 8  # words of a minimiser
HOT = 4_000  # strings of one minimiser above which its windows travel alone
BUCKET_STRINGS = 2_000
BATCH = 500  # rows of text that go to Python at a time
_PLACE = U((1 << 26) - 1)
_MULTIPLIERS = np.random.default_rng(35).integers(1, 1 << 63, RUN, dtype=np.uint64) | U(1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if size < width else out


class Runs:
    """Super-k-mers of a slice of texts: text, first word in the slice, number of windows and minimiser of each."""

    def __init__(self, w: Words, window: int):
        n, none = len(w.hash), np.zeros(0, dtype=np.int64)
        self.text, self.first, self.count, self.minimiser = none, none, none, none.view(np.uint64)
        if n < window:
            return
        run = min(RUN, window)
        grams = np.zeros(n - run + 1, dtype=np.uint64)
        for k in range(run):
            grams += mix(w.hash[k : n - run + 1 + k] * _MULTIPLIERS[k])
        grams = mix(grams)
        placed = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
        least = _sliding_min(placed, window - run + 1)
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        valid = text[: n - window + 1] == text[window - 1 :]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1 : n - window + 1] != text[: n - window])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        self.first = np.flatnonzero(new)
        self.count = np.flatnonzero(last) - self.first + 1
        self.text = text[self.first]
        at = self.first + ((least[self.first] & _PLACE).astype(np.int64) - self.first) % int(_PLACE + U(1))
        self.minimiser = grams[at]


def _surveyed(window: int):
    """Row by row: number of words, digest of the words, minimiser of each super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                runs, (packed, at) = Runs(w, window), w.packed()
                cut = np.searchsorted(runs.text, np.arange(b - a + 1))
                data = packed.tobytes()
                digests = [hashlib.sha256(data[at[i] : max(at[i], at[j] - 1)]).hexdigest() for i, j in zip(w.first, w.first[1:], strict=False)]
                mins = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(runs.minimiser.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(digests, pa.string()), mins],
                    names=["doc_id", "key", "n_words", "sha", "minimisers"],
                )

    return run


def _strings(window: int):
    """The packed strings of the minimisers that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                runs, (packed, at) = Runs(w, window), w.packed()
                data, keys = packed.tobytes(), batch.column("key").slice(a, b - a)
                cut = np.searchsorted(runs.text, np.arange(b - a + 1))
                rows: list[tuple] = []
                for t in range(b - a):
                    places: dict[tuple, list[int]] = {}  # equal strings of a text travel once
                    asked = {m: h for m, h in zip(batch.column("minimisers")[a + t].as_py(), batch.column("hot")[a + t].as_py(), strict=True)}
                    for r in range(cut[t], cut[t + 1]):
                        m = int(runs.minimiser[r].view(np.int64))
                        if m in asked:
                            f, c = int(runs.first[r]), int(runs.count[r])
                            places.setdefault((m, data[at[f] : at[f + c + window - 1] - 1]), []).append(f - int(w.first[t]))
                    rows += [(t, m, asked[m], starts, packed) for (m, packed), starts in places.items()]
                t, m, hot, starts, text = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(t, pa.int32())), pa.array(m, pa.int64()), pa.array(hot, pa.bool_()), pa.array(starts, pa.list_(pa.int64())), pa.array(text, pa.binary())],
                    names=["key", "minimiser", "hot", "starts", "packed"],
                )

    return run


def _windows(window: int):
    """The windows of packed strings, each with its string, place and the number of copies of the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 1000):
                batch = whole.slice(cut, 1000)
                row, place, words = [], [], []
                for r, packed in enumerate(batch.column("packed").to_pylist()):
                    sizes = np.fromiter(map(len, packed.split(b" ")), dtype=np.int64)
                    at = np.concatenate(([0], np.cumsum(sizes + 1))).tolist()
                    for i in range(len(sizes) - window + 1):
                        row.append(r)
                        place.append(i)
                        words.append(packed[at[i] : at[i + window] - 1])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("id").take(at), pa.array(place, pa.int64()), batch.column("n").take(at)], names=["words", "id", "place", "n"])

    return run


def _bucket(window: int):
    """The windows of a bucket in order of their words: those that are equal to a neighbour are repeated."""

    def run(rows: pa.Table) -> pa.Table:
        windows, owner, place = [], [], []
        starts = rows["starts"].to_pylist()
        for r, packed in enumerate(rows["packed"].to_pylist()):
            sizes = np.fromiter(map(len, packed.split(b" ")), dtype=np.int64)
            at = np.concatenate(([0], np.cumsum(sizes + 1))).tolist()
            for i in range(len(sizes) - window + 1):
                windows.append(packed[at[i] : at[i + window] - 1])
                owner.append(r)
                place.append(i)
        order = sorted(range(len(windows)), key=windows.__getitem__)
        found: dict[int, set[int]] = {r: set(range(len(p.split(b" ")) - window + 1)) for r, p in enumerate(rows["packed"].to_pylist()) if len(starts[r]) > 1}
        for i, j in zip(order, order[1:], strict=False):
            if windows[i] == windows[j]:
                found.setdefault(owner[i], set()).add(place[i])
                found.setdefault(owner[j], set()).add(place[j])
        hit = sorted(found)
        places = [sorted({s + i for s in starts[r] for i in found[r]}) for r in hit]
        return pa.table({"key": rows["key"].take(pa.array(hit, pa.int64())), "starts": pa.array(places, pa.list_(pa.int64()))})

    return run


_CLEANED = "key binary, n_removed long, kept_sha256 string, kept string"


def _cleaned(window: int, texts: bool = False):
    """Text by text: how many words go, the digest of those that stay and, if asked for, they themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                packed, at = w.packed()
                data, removed, digests = packed.tobytes(), [], []
                for t in range(b - a):
                    f, n = int(w.first[t]), int(w.first[t + 1] - w.first[t])
                    edge = np.zeros(n + 1, dtype=np.int64)
                    starts = np.array(batch.column("starts")[a + t].as_py(), dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    removed.append(int(gone.sum()))
                    kept = b" ".join(data[at[f + i] : at[f + i + 1] - 1] for i in np.flatnonzero(~gone))
                    digests.append((hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(removed, pa.int64()), pa.array([d for d, _ in digests], pa.string()), pa.array([k for _, k in digests], pa.string())],
                    names=["key", "n_removed", "kept_sha256", "kept"],
                )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(survey, texts): survey has a row per row of `docs` with doc_id, key of the text, n_words, sha (of its words), copies;
    texts has key, text and the sorted starts of the repeated windows of each text that shares one with another place."""
    base = docs.select("doc_id", F.col("text"), text_key(F.col("text")).alias("key"))
    kind = dict(base.dtypes)["doc_id"]
    rows = materialise(base.mapInArrow(_surveyed(window), f"doc_id {kind}, key binary, n_words long, sha string, minimisers array<long>"), "sub-survey", BATCH)
    texts = materialise(rows.groupBy("key").agg(F.first("minimisers").alias("minimisers"), F.count(F.lit(1)).alias("copies")), "sub-texts")
    one = texts.select("key", F.explode("minimisers").alias("minimiser"))
    # written out, so that the join exchanges both sides and splits what is skewed
    counts = materialise(one.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sub-counts")
    # one row per text and minimiser, also of a minimiser that a text has in many places
    each = texts.select("key", F.explode(F.array_distinct("minimisers")).alias("minimiser"))
    asked = each.join(counts, "minimiser").select("key", "minimiser", (F.col("n") > HOT).alias("hot"))
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("minimiser", "hot")).alias("a"))
    whole = base.groupBy("key").agg(F.first("text").alias("text"))
    shared = materialise(asked.join(whole, "key").select("key", "text", F.col("a.minimiser").alias("minimisers"), F.col("a.hot").alias("hot")), "sub-shared")
    strings = materialise(shared.mapInArrow(_strings(window), "key binary, minimiser long, hot boolean, starts array<long>, packed binary"), "sub-strings", BATCH)
    n = strings.filter("not hot").count()
    cold = strings.filter("not hot").withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(max(1, math.ceil(n / BUCKET_STRINGS)))))
    found = cold.select("bucket", "key", "starts", "packed").groupBy("bucket").applyInArrow(_bucket(window), "key binary, starts array<long>")
    starts = found.unionByName(_hot(strings.filter("hot"), window))
    starts = starts.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    return rows.drop("minimisers").join(texts.select("key", "copies"), "key"), shared.select("key", "text").join(starts, "key")


def _hot(strings: DataFrame, window: int) -> DataFrame:
    """Repeated windows of the strings of hot minimisers: key, starts."""
    strings = strings.select("key", "starts", "packed", F.substring(F.unhex(F.sha2("packed", 256)), 1, 16).alias("id"))
    distinct = materialise(strings.groupBy("id").agg(F.first("packed").alias("packed"), F.sum(F.size("starts")).cast("long").alias("n")), "sub-hot")
    each = materialise(distinct.select("packed", "id", "n").mapInArrow(_windows(window), "words binary, id binary, place long, n long"), "sub-hot-windows", BATCH)
    twice = each.groupBy("words").agg(F.sum("n").alias("n")).filter("n > 1").select("words")
    # places of a string whose windows are all repeated, being copied itself, need no look-up
    once = materialise(each.filter("n = 1").join(twice, "words").groupBy("id").agg(F.collect_list("place").alias("places")), "sub-hot-places")
    copied = distinct.filter("n > 1").select("id", F.sequence(F.lit(0).cast("long"), F.size(F.split(F.col("packed").cast("string"), " ")).cast("long") - window).alias("places"))
    back = strings.select("id", "key", "starts").join(materialise(once.unionByName(copied), "sub-hot-back"), "id")
    return back.select("key", F.flatten(F.transform("starts", lambda s: F.transform("places", lambda p: p + s))).alias("starts"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, one row per row of `docs`."""
    survey, texts = repeated_windows(docs, window)
    cleaned = texts.mapInArrow(_cleaned(window), _CLEANED).drop("kept")
    nothing = hashlib.sha256(b"").hexdigest()
    out, copied = survey.join(cleaned, "key", "left"), (F.col("copies") > 1) & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text key and the text that stays (words joined by one blank) of the rows that lose words."""
    survey, texts = repeated_windows(docs, window)
    cleaned = texts.mapInArrow(_cleaned(window, True), _CLEANED)
    out = survey.join(cleaned, "key", "left").withColumn("copied", (F.col("copies") > 1) & (F.col("n_words") >= window))
    return out.filter("copied or n_removed > 0").select("doc_id", "key", F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
