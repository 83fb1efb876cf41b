"""Words of many texts at once: places and 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is cut after a break.
RUN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1
_powers: tuple[np.ndarray, np.ndarray] | None = None

#: Each byte as itself, A-Z lower-cased, and the white space U+0020 and U+0009 to U+000D as a break (0).
SPACED = np.array([0 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: The same with every ASCII character that is no letter or digit as a break.
WORDS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
#: Byte 0 is a character of its own under SPACED.
_NUL = np.uint64(257)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, RUN + 1), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def _hash_run(raw: np.ndarray, table: np.ndarray, stop=None) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words in the bytes; with stop(raw, starts, ends), the ends of their beginnings and the hashes of these too."""
    line = table[raw]
    inside = line != 0
    if table is SPACED:
        inside |= raw == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    value = line.astype(np.uint64) + np.uint64(1)
    if table is SPACED:
        value[raw == 0] = _NUL
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value * up[: len(raw)], out=total[1:])
    hashes = lambda to: mix((total[to] - total[starts]) * down[starts] + (to - starts).astype(np.uint64))
    if stop is None:
        return starts, ends, hashes(ends)
    stops = stop(raw, starts, ends)
    return starts, ends, hashes(ends), stops, hashes(stops)


def words(raw: bytes | np.ndarray, table: np.ndarray, stop=None) -> tuple[np.ndarray, ...]:
    """Starts, ends (bytes) and hashes of the words of one text; see _hash_run."""
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    if len(raw) <= RUN:
        return _hash_run(raw, table, stop)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + RUN)
        while end < len(raw):  # back to a break, or else on to the next one
            breaks = np.flatnonzero((table[raw[at:end]] == 0) & (raw[at:end] != 0 if table is SPACED else True))
            if len(breaks):
                end = at + int(breaks[-1]) + 1
                break
            end = min(len(raw), end + RUN)
        s, e, h, *more = _hash_run(raw[at:end], table, stop)
        found.append((s + at, e + at, h, *(x if i else x + at for i, x in enumerate(more))))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts as (first index, their bytes with a space after each, where each ends): RUN bytes, or one longer text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + RUN, "right")) - 1)
        n = np.diff(offsets[begin : end + 1])
        apart = np.full(int(n.sum()) + len(n), 32, np.uint8)
        apart[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = data[offsets[begin] : offsets[end]]
        yield begin, apart, np.cumsum(n + 1)
        begin = end


def each(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first index, how many words each text has, hashes of all their words in order)."""
    for begin, line, ends in runs(texts):
        starts, _, h = words(line, table)
        yield begin, np.diff(np.searchsorted(starts, ends), prepend=0), h


def hash_of(value: str) -> int:
    """A signed 64-bit hash of a string, the same everywhere."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted slice values[low:high], the first place that isn't below the wanted value, and whether it equals it."""
    place, size = low.astype(np.int64), high.astype(np.int64) - low.astype(np.int64)
    some = np.flatnonzero(size > 0)
    steps = np.frexp((size[some] - 1).astype(np.float64))[1].astype(np.uint8)  # halvings until one value is left
    order = np.argsort(~steps, kind="stable")  # the longest slices first, so that each halving takes the first ones
    some, left = some[order], np.cumsum(np.bincount(steps, minlength=1)[::-1])[::-1]
    at, n, want = place[some], size[some], wanted[some]
    for m in left[1:].tolist():
        half = n[:m] >> 1
        at[:m] += half * (values[at[:m] + half - 1] < want[:m])
        n[:m] -= half
    found = np.zeros(len(size), bool)
    if len(some):
        at += values[at] < want
        last = at < high[some]
        last[last] = values[at[last]] == want[last]
        place[some], found[some] = at, last
    return place, found
