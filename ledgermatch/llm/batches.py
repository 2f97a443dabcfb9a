"""Texts of an Arrow column as flat numpy arrays: bytes, words, lines and their hashes.

All word classes used here are defined by ASCII bytes only, so UTF-8 bytes can be
split without decoding. Work is done in runs of rows of bounded size; only a
text that is larger by itself makes a larger run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once.
RUN_BYTES = 1 << 20

#: Stretches of so many bytes are hashed one by one.
LONG_BYTES = 256

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_LOW = _powers(1 << 14, _BASE)
_HIGH_BASE = pow(_BASE, 1 << 14, 1 << 64)


def powers_at(places: np.ndarray) -> np.ndarray:
    """The hash base to the power of each place (places from 0)."""
    low = _LOW[places & 0x3FFF]
    top = int(places.max(initial=0)) >> 14
    if top:
        with np.errstate(over="ignore"):
            low = low * _powers(top + 1, _HIGH_BASE)[places >> 14]
    return low


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Run:
    """Some rows of a column: ``data`` are their bytes, row i is data[bounds[i]:bounds[i+1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one per byte) over each row."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def pieces(self, inside: np.ndarray) -> Pieces:
        """Maximal runs of bytes for which ``inside`` holds, within a row."""
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = self.bounds[:-1][self.bounds[:-1] < len(self.data)]
        start[first] = inside[first]
        starts = np.flatnonzero(start)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        last = self.bounds[1:][self.bounds[1:] > 0] - 1
        stop[last] = inside[last]
        return Pieces(self, starts, np.flatnonzero(stop) + 1)

    def lines(self) -> Pieces:
        """Lines between newlines, blank ones too (a row of no bytes has one)."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], feeds + 1]))
        # A newline at the end of a row puts the next row's first line and this row's last at one place: both stay.
        stops = np.sort(np.concatenate([self.bounds[1:], feeds]))
        return Pieces(self, starts, stops)


class Pieces:
    """Stretches of a run, in order: words or lines."""

    def __init__(self, run: Run, starts: np.ndarray, stops: np.ndarray) -> None:
        self.run, self.starts, self.stops = run, starts, stops

    def __len__(self) -> int:
        return len(self.starts)

    def firsts(self) -> np.ndarray:
        """Index of each row's first word, then their number (for non-empty stretches)."""
        return np.searchsorted(self.starts, self.run.bounds)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each stretch's bytes (of ``data`` in place of the run's).

        Short ones are hashed in bulk by a polynomial. From some thousand bytes on there are texts made to clash
        under any such polynomial, so long ones are hashed by themselves.
        """
        data = self.run.data if data is None else data
        lengths = self.stops - self.starts
        out = np.zeros(len(self), np.uint64)
        full, large = np.flatnonzero((lengths > 0) & (lengths < LONG_BYTES)), np.flatnonzero(lengths >= LONG_BYTES)
        if len(full):
            lengths, starts = lengths[full], self.starts[full]
            heads = np.zeros(len(full), np.int64)
            np.cumsum(lengths[:-1], out=heads[1:])
            place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
            with np.errstate(over="ignore"):
                terms = (data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers_at(place)
                out[full] = np.add.reduceat(terms, heads)
        out = mix(out)
        for i in large:
            out[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[self.starts[i] : self.stops[i]]))
        return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes, whatever rows they come from."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)


def byte_class(pattern: bytes, *, without: bool = False) -> np.ndarray:
    """A table over bytes: true for those in ``pattern`` (``without``: not in it)."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern, np.uint8)] = True
    return ~out if without else out


#: Bytes of words [^\x20\x09-\x0D]+
PLAIN_WORD = byte_class(b" \t\n\v\f\r", without=True)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-case text: digits, a-z, all beyond ASCII.
STRICT_WORD = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """The rows of a text column in order; NULL counts as no bytes."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column), at + 65536)
        yield Run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
