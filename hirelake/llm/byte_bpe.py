"""Byte-level BPE encoding and decoding of texts of any length, in overlapping chunks.

A text of up to CHUNK characters is one piece. A longer one is cut into chunks that reach OVERLAP characters into the
next; chunks are spread over tasks and pre-tokenised beside one another, each from its own start. They are stitched
where the pre-token boundaries of a chunk and of the next one meet within the overlap, at a place that is a boundary
wherever one starts: a letter before something else than a letter, a digit likewise, or another sign before white
space, which no pre-token contains. From such a place on both go the same way, because a match depends only on what
follows its start. Boundaries near a chunk's end, which the text beyond could move, don't count. Where no boundary is
shared, as within a very long run, chunks are put together and pre-tokenised anew. The pieces between stitches are then
encoded, again beside one another, and the ids of a text are put together in order. Long texts that are equal are
encoded once.

A pre-token that is in the vocabulary is one id; of others, the adjacent pair of the least rank is merged, leftmost first,
until none is left. Long pre-tokens are first cut between bytes that no entry has beside one another; a part with no
such place takes some 40 times its size as memory, and time as n log n.

`ids` are little-endian unsigned 32-bit integers, one after another, so a text may have 2^29 tokens. Null texts are encoded
as empty ones. Bytes that are no UTF-8 count as U+FFFD. Rows are judged alone; an empty table gives an empty result.
Columns stay; where one has the name of a new column, the new one gets `_` appended.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from hirelake.llm.common import free_name, materialise, text_key

CHUNK = 32_768
OVERLAP = 1_024
LOOKAHEAD = 3  # characters from its start that an alternative of fixed length can look at
SLICE_ROWS = 500
CACHED = 300_000  # pre-tokens whose ids a worker keeps
CACHED_CHARS = 64
SHORT_BYTES = 48
NONE = 1 << 31
#: No pre-token has the two characters around such a place in it.
FIRM = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}])(?=\s)")


def vocabulary_file(path: str | None = None) -> bytes:
    """The lines of a rank file: base64 of the bytes, then the rank. By default the public vocabulary of 50,256 entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Path(path).read_bytes()


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary(dict):
    """Ids of pre-tokens, packed; a pre-token that is asked for and missing is encoded, and kept if it is short."""

    def __init__(self, file: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._beside: np.ndarray | None = None

    def __missing__(self, pre_token: str) -> bytes:
        data = pre_token.encode("utf-8", "replace")
        rank = self.ranks.get(data)
        out = array("I", [rank] if rank is not None else self.merged(data)).tobytes()
        if len(pre_token) <= CACHED_CHARS:
            self[pre_token] = out
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(self.pattern.findall(text))

    def encode_all(self, pre_tokens: list[str]) -> bytes:
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, pre_tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def merged(self, data: bytes) -> list[int]:
        """Ids after all merges."""
        if len(data) <= SHORT_BYTES:
            return self._merge_short(data)
        out: list[int] = []
        for part in self._parts(data):
            out.extend(self._merge_short(part) if len(part) <= SHORT_BYTES else self._merge_long(part))
        return out

    def _parts(self, data: bytes) -> Iterator[bytes]:
        """data, cut between bytes that no entry has beside one another: no merge goes over such a place."""
        if self._beside is None:
            self._beside = np.zeros(1 << 16, bool)
            for token in self.ranks:
                for a, b in zip(token, token[1:], strict=False):
                    self._beside[a << 8 | b] = True
        codes = np.frombuffer(data, np.uint8)
        cuts = [0, *(np.flatnonzero(~self._beside[codes[:-1].astype(np.uint16) << 8 | codes[1:]]) + 1).tolist(), len(data)]
        return (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def _merge_short(self, data: bytes) -> list[int]:
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a queue. The pairs of the start are sorted once; the queue has only those that merges make."""
        ranks, tokens, n = self.ranks, self.tokens, len(data)
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        codes = np.frombuffer(data, np.uint8)
        both = codes[:-1].astype(np.int32) << 8 | codes[1:]
        table = np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)
        first = table[both]
        order = np.argsort(first, kind="stable").astype(np.int32)
        stop = int(np.count_nonzero(first < NONE))
        starts, start_ranks = array("i", order[:stop].tobytes()), array("q", first[order[:stop]].tobytes())
        del both, first, order
        ids = array("i", single[codes].astype(np.int32).tobytes())
        following, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        made: list[int] = []  # rank, then place, in one number
        pair_of: dict[tuple[int, int], int] = {}

        def rank_of(i: int) -> int:
            j = following[i]
            if j >= n:
                return NONE
            pair = ids[i], ids[j]
            rank = pair_of.get(pair)
            if rank is None:
                rank = pair_of[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]], NONE)
            return rank

        at = 0
        while at < stop or made:
            if at < stop and (not made or (start_ranks[at] << 32 | starts[at]) <= made[0]):
                rank, i = start_ranks[at], starts[at]
                at += 1
            else:
                rank, i = divmod(heapq.heappop(made), 1 << 32)
            if ids[i] < 0 or rank_of(i) != rank:
                continue  # one of the two has been merged since
            j = following[i]
            ids[i], ids[j], following[i] = rank, -1, following[j]
            if following[j] < n:
                before[following[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank_of(k)) != NONE:
                    heapq.heappush(made, new << 32 | k)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One a worker, kept from task to task. shared: broadcast of (file, pattern)."""
    file, pattern = shared.value
    name = hashlib.sha256(file + pattern.encode()).hexdigest()
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(file, pattern)
    return _vocabularies[name]


def _texts(column: pa.Array) -> list[str]:
    return [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in column]


def _short_encoder(shared, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for whole in batches:
            rest = [c for c in whole.schema.names if c != body]
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                ids = pa.array([vocabulary.encode(t) for t in _texts(batch.column(body))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), ids], names=[*rest, "_ids"])

    return run


def _cutter(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, column in zip(batch.column("_key"), batch.column("_text"), strict=True):
                text = _texts([column])[0]
                for at in range(0, len(text), chunk * 64):
                    cuts = range(at, min(at + chunk * 64, len(text)), chunk)
                    parts = [text[a : a + chunk + overlap] for a in cuts]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(parts), pa.binary()), pa.array([a // chunk for a in cuts], pa.int32()), pa.array(parts, pa.string())], names=["_key", "_part", "_chunk"])

    return run


def boundaries(text: str, pattern: regex.Pattern, ends: bool) -> np.ndarray:
    """0 and the ends of pre-tokens, as far as nothing beyond the text could move them. ends: nothing is beyond."""
    out = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pattern.findall(text)), np.int64)))).astype(np.int32)
    if ends:
        return out
    sure = (out[:-1] + LOOKAHEAD <= len(text)) & (out[1:] < len(text))
    return out[: 1 + (len(sure) if sure.all() else int(np.argmin(sure)))]


def _pre_tokeniser(shared, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _vocabulary(shared).pattern
        for batch in batches:
            all_, heads, tails = [], [], []
            texts = _texts(batch.column("_chunk"))
            for text in texts:
                found = boundaries(text, pattern, len(text) < chunk + overlap)
                all_.append(found.tobytes())
                heads.append(found[found <= overlap])
                tails.append([b - chunk for b in found[found >= chunk].tolist() if FIRM.match(text, b)])
            kinds = pa.list_(pa.int32())
            new = [pa.array(all_, pa.binary()), pa.array(heads, kinds), pa.array(tails, kinds), pa.array(map(len, texts), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_bounds", "_head", "_tail", "_length"])

    return run


def stitches(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """_key, _part, _group (the first chunk of the piece), _from and _to (the part of the chunk that belongs to it) and _alone.
    Only boundaries in overlaps are read; a text has a row for each chunk."""
    order = W.partitionBy("_key").orderBy("_part")
    d = chunks.select("_key", "_part", "_length", F.array_min(F.array_intersect(F.lag("_tail").over(order), "_head")).alias("_sync"))
    d = d.withColumns({"_new": (F.col("_part") == 0) | F.col("_sync").isNotNull(), "_more": F.lead("_part").over(order).isNotNull(), "_then": F.lead("_sync").over(order)})
    to = F.when(~F.col("_more"), F.col("_length")).otherwise(F.lit(chunk) + F.coalesce("_then", F.lit(0)))
    group = F.max(F.when(F.col("_new"), F.col("_part"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    alone = F.col("_new") & (~F.col("_more") | F.col("_then").isNotNull())
    return d.select("_key", "_part", group.alias("_group"), F.coalesce("_sync", F.lit(0)).alias("_from"), to.alias("_to"), alone.alias("_alone"))


_PIECES = "_key binary, _group int, _ids binary"


def _narrow(ids: bytes, width: str) -> bytes:
    return np.frombuffer(ids, "<u4").astype(width).tobytes()


def _piece_encoder(shared, width: str):
    """Pieces of one chunk: their pre-tokens are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            out = []
            for text, found, a, b in zip(_texts(batch.column("_chunk")), batch.column("_bounds").to_pylist(), batch.column("_from").to_pylist(), batch.column("_to").to_pylist(), strict=True):
                found = np.frombuffer(found, np.int32)
                edges = found[np.searchsorted(found, a) : np.searchsorted(found, b) + 1].tolist()
                out.append(_narrow(vocabulary.encode_all([text[x:y] for x, y in zip(edges, edges[1:], strict=False)]), width))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_group"), pa.array(out, pa.binary())], names=["_key", "_group", "_ids"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], value: str) -> Iterator[tuple[tuple, list]]:
    """(key, values) of rows that come sorted by the columns `names`."""
    key, parts = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        for k, v in zip(keys, batch.column(value), strict=True):
            if k != key and key is not None:
                yield key, parts
                parts = []
            key = k
            parts.append(v.as_buffer().to_pybytes())
    if key is not None:
        yield key, parts


def _run_encoder(shared, width: str):
    """Pieces of several chunks, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for (key, group), parts in _runs(batches, ["_key", "_group"], "_piece"):
            ids = _narrow(vocabulary.encode(b"".join(parts).decode("utf-8", "replace")), width)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([group], pa.int32()), pa.array([ids], pa.binary())], names=["_key", "_group", "_ids"])

    return run


def _joiner(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), parts in _runs(batches, ["_key"], "_ids"):
            ids = np.frombuffer(b"".join(parts), width).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids], pa.binary())], names=["_key", "_ids"])

    return run


def _encode_long(texts: DataFrame, shared, width: str, chunk: int, overlap: int) -> DataFrame:
    """_key and _ids of texts (_key, _text): each key once."""
    cut = texts.mapInArrow(_cutter(chunk, overlap), "_key binary, _part int, _chunk string")
    spread = cut.dropDuplicates(["_key", "_part"]).select("_key", "_part", "_chunk")
    found = "_key binary, _part int, _chunk string, _bounds binary, _head array<int>, _tail array<int>, _length int"
    chunks = materialise(spread.mapInArrow(_pre_tokeniser(shared, chunk, overlap), found), "bpe-chunks")
    placed = chunks.select("_key", "_part", "_chunk", "_bounds").join(stitches(chunks, chunk), ["_key", "_part"])
    alone = placed.filter("_alone").select("_key", "_group", "_chunk", "_bounds", "_from", "_to").mapInArrow(_piece_encoder(shared, width), _PIECES)
    piece = F.substring("_chunk", F.col("_from") + 1, F.col("_to") - F.col("_from"))
    runs = placed.filter("NOT _alone").select("_key", "_group", "_part", piece.alias("_piece")).repartition("_key", "_group").sortWithinPartitions("_key", "_group", "_part")
    pieces = alone.unionByName(runs.select("_key", "_group", "_piece").mapInArrow(_run_encoder(shared, width), _PIECES))
    ordered = pieces.repartition("_key").sortWithinPartitions("_key", "_group").select("_key", "_ids")
    return materialise(ordered.mapInArrow(_joiner(width), "_key binary, _ids binary"), "bpe-ids")


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of `docs` (or those in `keep`) and ids (binary)."""
    if not LOOKAHEAD <= overlap <= chunk:
        raise ValueError(f"overlap must be from {LOOKAHEAD} to the size of a chunk")
    keep = docs.columns if keep is None else keep
    file = vocabulary_file(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((file, public_pattern()))
    width = "<u2" if len(file.splitlines()) <= 1 << 16 else "<u4"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_row"), body.alias("_text"))
    is_long = F.length("_text") > chunk
    made = StructType([rows.schema["_row"], StructField("_ids", BinaryType())])
    short = rows.filter(~is_long).mapInArrow(_short_encoder(shared, "_text"), made)
    keyed = rows.filter(is_long).withColumn("_key", text_key(F.col("_text")))
    known = _encode_long(keyed.select("_key", "_text"), shared, width, chunk, overlap)
    out = short.unionByName(keyed.select("_row", "_key").join(known, "_key").select("_row", "_ids"))
    return out.select("_row.*", F.col("_ids").alias(free_name(keep, "ids")))


def _decoder(shared, ids: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                out = [vocabulary.decode(x.as_buffer()) if x.is_valid else None for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return run


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The columns of `rows` and decoded: the bytes of the ids, one after another; null for null."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary_file(vocabulary), public_pattern()))
    name = free_name(rows.columns, "decoded")
    return rows.mapInArrow(_decoder(shared, ids, name), StructType([*rows.schema.fields, StructField(name, BinaryType())]))
