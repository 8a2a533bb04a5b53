"""Words of many texts at once: byte offsets and 64-bit hashes as numpy arrays. Runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 18  # text handled at a time, so that working arrays stay small
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Words of a run of texts. data: their bytes; start, end: of each word; hash: of each word;
    first: index of the first word of each text, with the number of words at the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        if lower:
            data = _LOWER[data]
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        before[1:] = word[:-1]
        if n:
            before[0] = False
        after = np.empty(n, dtype=bool)
        after[:-1] = word[1:]
        if n:
            after[-1] = False
        self.data = data
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
        down = _power("down", pow(_BASE, -1, 1 << 64), n)
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length) if n else total[:0]
        self.first = np.searchsorted(self.start, bounds)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """All words joined by one blank each, and where each word starts in that."""
        size = self.end - self.start + 1
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.full(int(at[-1]), 32, dtype=np.uint8)
        inside = np.ones(int(at[-1]), dtype=bool)
        inside[at[1:] - 1] = False
        keep = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(keep, self.start, 1)
        np.add.at(keep, self.end, -1)
        out[inside] = self.data[np.cumsum(keep[:-1]).astype(bool)]
        return out, at


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of texts of some SLICE_BYTES; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, side="right")) - 1)
        yield row, stop, Words(raw[off[row] : off[stop]], off[row : stop + 1] - off[row], lower)
        row = stop
    pa.default_memory_pool().release_unused()  # a worker lives on between batches and tasks
