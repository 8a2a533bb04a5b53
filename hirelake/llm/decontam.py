"""Benchmark decontamination: item-sized windows of each document get a SimHash, multi-index Hamming blocks
keep the windows whose fingerprint can be within the radius of an item's, and an exact weighted-shingle cosine decides.

Fingerprints of all windows of all sizes would be most of the work, so the places where a document has shingles of
an item come first: they give the product of every window with the item, hence an upper bound of its cosine. Each
start whose bound reaches the threshold is fingerprinted; the others can't match. A document with fewer words than
an item is its one window. Thresholds are compared in whole numbers, so a cosine of exactly 0.8 counts.

The corpus is read once, whatever the size of the benchmark: a Bloom filter of at most MOST_BITS bits tells the
places that may hold a shingle of it, and what it lets through is joined with the shingles themselves. Documents
with such a place are written out once; items and shingles are broadcast up to BROADCAST_ROWS, else shuffled.

Words are lower-cased runs of letters and digits. Null or wordless items and texts match nothing. Items under five
words are one shingle. Rows with the same doc_id and text give one result. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import broadcast_small, free_name, made, materialise, settle, text_key

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 29  # of 64 bits; a pair at cosine 0.8 differs in 13 on average, with deviation 3.2
BITS_A_KEY = 64
MOST_BITS = 1 << 23  # of the Bloom filter
PROBES = 3
BROADCAST_ROWS = 200_000  # items or shingles, under 64 bytes a shingle
NOT_WORD = r"[^\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(tokens: str, size: int = SHINGLE) -> Column:
    """Hash of the shingle at each position; under `size` words the whole sequence is one."""
    run = F.transform(F.col(tokens), lambda w, i: F.xxhash64(w, *(F.get(F.col(tokens), i + k) for k in range(1, size))))
    return F.slice(run, F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.least(F.size(tokens), F.lit(1))))


def _sized(tokens: str, size: Column, sizes: list[int]) -> Column:
    out = F.array().cast("array<bigint>")
    for s in sizes:
        out = F.when(size == s, _shingles(tokens, s)).otherwise(out)
    return out


def _fingerprint(shingles: str, most: int) -> Column:
    """64-bit SimHash of an array of up to `most` shingles, each weighing as often as it occurs. Bits are counted in
    planes: plane k holds bit k of all 64 counts, so a shingle is added to all of them at once."""
    planes, zero = range(max(1, most.bit_length())), F.lit(0).cast("long")

    def add(acc: Column, h: Column) -> Column:
        out, carry = [], h
        for k in planes:
            out.append(acc[f"c{k}"].bitwiseXOR(carry).alias(f"c{k}"))
            carry = acc[f"c{k}"].bitwiseAND(carry)
        return F.struct(*out)

    def majority(acc: Column) -> Column:
        """Bits whose count is more than half of the shingles: planes are compared with the bits of that half, highest first."""
        half, above, same = F.floor(F.size(shingles) / 2).cast("long"), zero, F.lit(-1).cast("long")
        for k in reversed(planes):
            bit, c = -F.getbit(half, F.lit(k)).cast("long"), acc[f"c{k}"]
            above = above.bitwiseOR(same.bitwiseAND(c).bitwiseAND(F.bitwise_not(bit)))
            same = same.bitwiseAND(F.bitwise_not(c.bitwiseXOR(bit)))
        return above

    return F.aggregate(shingles, F.struct(*(zero.alias(f"c{k}") for k in planes)), add, majority)


def _blocks(fingerprint: str, radius: int) -> Column:
    """radius + 1 blocks, each a number with its bits: two fingerprints within the radius agree on one of them at least."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    bits = lambda lo, hi: F.shiftrightunsigned(F.shiftleft(fingerprint, 64 - hi), 64 - (hi - lo))
    return F.array(*(F.lit(i * 65536).cast("long") + bits(lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def _square(shingles: str) -> Column:
    """Sum of the squares of how often each shingle occurs."""
    count = lambda h: F.size(F.filter(F.col(shingles), lambda x: x == h)).cast("long")
    total = F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + count(h))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.size(shingles).cast("long")).otherwise(total)


def _length(n_words: Column, item_words: Column) -> Column:
    """Shingles of a window: it has as many words as the item, or all that the document has."""
    return F.greatest(F.least(n_words, item_words) - F.least(item_words, F.lit(SHINGLE)) + 1, F.lit(1))


def _reaches(dot: Column, square: Column, other: Column, similarity: float) -> Column:
    """Whether dot / sqrt(square * other) >= similarity, in whole numbers."""
    s, whole = Fraction(str(similarity)) ** 2, lambda c: c.cast("decimal(18,0)")
    return whole(dot) * whole(dot) * F.lit(s.denominator) >= whole(square) * whole(other) * F.lit(s.numerator)


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, names): one row per distinct item with item_key, item_words, size of its shingles, shingles and square; and
    item_key with each item_id that has it. Dealt out first, since items are costly and few."""
    d = benchmark.select("item_id", "text").repartition("item_id", "text").select("item_id", _tokens(F.col("text")).alias("_t")).filter(F.size("_t") > 0)
    d = d.withColumn("item_key", text_key(F.array_join("_t", " "))).withColumn("item_words", F.size("_t")).withColumn("size", F.least("item_words", F.lit(SHINGLE)))
    d = materialise(d, "decon-benchmark")
    one = d.groupBy("item_key", "item_words", "size").agg(F.first("_t").alias("_t"))
    one = materialise(one.withColumn("shingles", _sized("_t", F.col("size"), list(range(1, SHINGLE + 1)))).drop("_t"), "decon-shingles")
    return materialise(one.withColumn("square", _square("shingles")), "decon-items"), materialise(d.select("item_key", "item_id").distinct(), "decon-names")


def _probes(h: Column, bits: int) -> list[Column]:
    """The bits of a key in a filter of `bits` bits (a power of two)."""
    return [F.shiftrightunsigned(F.xxhash64(h, F.lit(k)), 13).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]


def _bloom(hashes: DataFrame, bits: int) -> Column:
    """A Bloom filter of the column h as a constant: an array of longs. At most MOST_BITS / 64 rows go to the driver."""
    at = hashes.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("at"))
    found = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return F.split(F.lit(",".join(map(str, out.tolist()))), ",").cast("array<bigint>")  # folded into one constant


def _may_hold(bloom: Column, h: Column, bits: int) -> Column:
    test = F.lit(True)
    for p in _probes(h, bits):
        test = test & (F.getbit(F.get(bloom, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return test


def match_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, key: str | None = None) -> DataFrame:
    """One row per matching (key, item): key columns, item_id, the best similarity, its start word, its length and its Hamming distance.
    key: "doc_id" gives doc_id and text key, "text" the text key alone."""
    keys = ["text_id"] if key == "text" else ["doc_id", "text_id"]
    items, names = _items(benchmark)
    stat = items.agg(F.count(F.lit(1)).alias("n"), F.max("item_words").alias("longest"), F.sort_array(F.collect_set("size")).alias("sizes"), F.sum(F.size("shingles")).alias("all")).first()
    sizes, most = stat["sizes"] or [SHINGLE], int(stat["longest"] or 1)
    per_item = items.select("item_key", "item_words", "size", "square", F.explode("shingles").alias("h"))
    per_item = per_item.groupBy("item_key", "item_words", "size", "square", "h").agg(F.count(F.lit(1)).cast("int").alias("times"))
    places = _places(docs, keys, per_item, sizes, int(stat["all"] or 0))
    at = places.select("_row", F.size("_t").alias("_n"), F.explode("_at").alias("x")).select("_row", "_n", "x.*")
    windows = _windows(at.join(broadcast_small(per_item, BROADCAST_ROWS, int(stat["all"] or 0)), ["size", "h"]), similarity)
    words = places.select("_row", *keys, "_t").join(windows, "_row").withColumn("_win", F.slice("_t", F.col("start") + 1, F.col("n_words"))).drop("_t")
    # written out, so that nothing is computed anew for each of its uses
    win = materialise(words.select(*keys, "item_key", "start", "n_words", "dot", _sized("_win", F.least("item_words", F.lit(SHINGLE)), sizes).alias("_ws")), "decon-windows")
    win = materialise(win.select("*", _square("_ws").alias("_square"), _fingerprint("_ws", most).alias("_print")).drop("_ws"), "decon-prints")
    its = items.select("item_key", "square", _fingerprint("shingles", most).alias("item_print"))
    pairs = win.join(broadcast_small(materialise(its, "decon-item-prints"), BROADCAST_ROWS // 10, int(stat["n"])), "item_key")
    pairs = pairs.filter(F.arrays_overlap(_blocks("_print", radius), _blocks("item_print", radius)))
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("_print").bitwiseXOR(F.col("item_print")))).filter(F.col("hamming") <= radius)
    pairs = pairs.filter(_reaches(F.col("dot"), F.col("_square"), F.col("square"), similarity))
    pairs = pairs.withColumn("similarity", F.round(F.col("dot") / F.sqrt(F.col("_square").cast("double") * F.col("square")), 6))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "hamming")).alias("best")
    found = pairs.groupBy(*keys, "item_key").agg(best).join(broadcast_small(names, BROADCAST_ROWS), "item_key")
    return found.select(*keys, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.hamming").cast("int").alias("hamming"))


def _places(docs: DataFrame, keys: list[str], per_item: DataFrame, sizes: list[int], shingles: int) -> DataFrame:
    """_row, key columns, words _t and places _at (size, h, p) of the documents that may hold a shingle of the benchmark."""
    bits = max(1 << 10, min(MOST_BITS, 1 << (BITS_A_KEY * shingles).bit_length()))
    bloom = _bloom(per_item.select("h"), bits)
    d = docs.select(*([F.col("doc_id")] if "doc_id" in keys else []), text_key(F.col("text")).alias("text_id"), _tokens(F.col("text")).alias("_t"))
    d = d.withColumns({f"_s{s}": _shingles("_t", s) for s in sizes})
    marked = lambda s: F.transform(f"_s{s}", lambda h, i: F.when(_may_hold(bloom, h, bits), F.struct(F.lit(s).alias("size"), h.alias("h"), i.alias("p"))))
    at = F.concat(*(F.filter(marked(s), lambda x: x.isNotNull()) for s in sizes))
    # the row number also keeps the optimizer from moving the filter below, where it would split each text anew for each word
    d = d.select(*keys, "_t", at.alias("_at"), F.monotonically_increasing_id().alias("_row"))
    return materialise(d.filter(F.size("_at") > 0), "decon-places")


def _windows(at: DataFrame, similarity: float) -> DataFrame:
    """_row, item_key, item_words, start, n_words and dot of the windows whose product with an item can reach the threshold.
    at: a row per place (_row, _n, p) and item (item_key, item_words, square, times)."""
    # Stretches of as many starts as the item has words: a window that starts in one ends before the end of the next.
    # A place counts for the windows that start in its own stretch and in the one before.
    own = F.floor(F.col("p") / F.col("item_words")).cast("int")
    d = at.withColumn("_c", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))))
    by = ["_row", "_n", "_c", "item_key", "item_words", "square"]
    d = d.groupBy(*by).agg(F.sum("times").alias("all"), F.collect_list(F.struct("p", "times")).alias("hits"))
    # the square of a window is at least its length; one less than the root allows for rounding, the exact test follows
    length = _length(F.col("_n"), F.col("item_words"))
    d = d.withColumn("_length", length).withColumn("_least", F.floor(similarity * F.sqrt(length * F.col("square").cast("double"))) - 1)
    d = d.filter(F.col("all") >= F.col("_least"))
    first = F.col("_c") * F.col("item_words")
    last = F.least(first + F.col("item_words") - 1, F.greatest(F.col("_n") - F.col("item_words"), F.lit(0)))
    inside = lambda s: F.filter("hits", lambda x: (x["p"] >= s) & (x["p"] < s + F.col("_length")))
    dot = lambda s: F.aggregate(inside(s), F.lit(0).cast("long"), lambda a, x: a + x["times"])
    starts = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), dot(s).alias("dot")))
    starts = F.filter(F.when(last >= first, starts), lambda x: x["dot"] >= F.col("_least"))
    return d.select("_row", "item_key", "item_words", F.least("_n", "item_words").alias("n_words"), F.explode(starts).alias("x")).select("_row", "item_key", "item_words", "n_words", "x.start", "x.dot")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` in whose text no window matches an item; columns as in `docs`."""
    since = len(made())
    hit = settle(match_windows(docs, benchmark, similarity, radius, key="text").select("text_id").distinct(), "decon-hits", since)
    name = free_name(docs.columns, "_text_id")
    hit = broadcast_small(hit.withColumnRenamed("text_id", name), BROADCAST_ROWS, hit.count())
    return docs.withColumn(name, text_key(F.col("text"))).join(hit, name, "left_anti").select(*docs.columns)
