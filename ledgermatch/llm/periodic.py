"""Periodic runs of words, found by an enhanced suffix array of each text.

A square is a stretch of words that is followed by itself. It is branching if the word after it
differs from the word after its first half, so each run holds one branching square of its
period: the last. Of that square both halves begin with the same words and part right after
them, so their suffixes lie in one interval of the suffix array whose common prefix is as long as the period,
in different children of it. For each such interval the suffixes of all children but the largest
ask by the inverse array whether the suffix one depth ahead, or one behind, lies in the interval too. A text of n words
asks n log n such questions at most. Squares found are rotated to the left as far as words agree, and
runs with the same ends are merged under their smallest period. Intervals are pairs of places in flat arrays;
no tree is built.

A run of three periods and 24 words repeats a window of 16 words one period on. Texts
without a repeated window of that length, which are most, need no suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.batches import mix

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Suffixes that ask at once.
ASKED = 1 << 20

_RUN = "struct<start:long,length:long,period:long>"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _repeats_a_window(ids: np.ndarray, width: int) -> bool:
    """Whether some window of ``width`` words (a power of two) may occur twice; False is certain."""
    if len(ids) <= width:
        return False
    hashes, held = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while held < width:
        with np.errstate(over="ignore"):
            hashes = mix(hashes[:-held] * np.uint64(0x9E3779B97F4A7C15) + hashes[held:])
        held *= 2
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to the first that are all different.

    Two suffixes of one rank have that many words, and the same.
    """
    n = len(ids)
    levels, held = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while levels[-1].max() < n - 1:
        key = levels[-1].astype(np.int64) * (n + 1)
        key[: n - held] += levels[-1][held:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        held *= 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, pair by pair."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        out += same << k
    return out


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` words (one at least) from a and from b on are the same; all lie inside."""
    out = np.zeros(len(a), bool)
    log = np.frexp(length.astype(float))[1] - 1
    for k, rank in enumerate(levels):
        at = np.flatnonzero(log == k)
        x, y, rest = a[at], b[at], length[at] - (1 << k)
        out[at] = (rank[x] == rank[y]) & (rank[x + rest] == rank[y + rest])
    return out  # no level: all prefixes of that length differ


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary of the suffix array the ends of the widest interval with a common prefix of lcp there.

    lcp[0] and lcp[n] are -1.
    """
    values = lcp.tolist()
    lo, hi = [0] * len(values), [0] * len(values)
    stack = [0]
    for r in range(1, len(values)):
        value = values[r]
        while values[stack[-1]] > value:
            hi[stack.pop()] = r
        top = stack[-1]
        lo[r] = lo[top] if values[top] == value else top
        stack.append(r)
    return np.array(lo), np.array(hi)


def _smaller_children(lcp: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """depth, lo and hi of intervals of depth 1 to ``longest``, beside the first and last place of each child but the largest."""
    lo, hi = _intervals(lcp)
    r = np.flatnonzero((lcp > 0) & (lcp <= longest))
    r = r[np.lexsort((r, lcp[r], lo[r]))]
    depth, lo, hi = lcp[r], lo[r], hi[r]
    new = np.ones(len(r), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    last = np.append(new[1:], True)[: len(r)]
    # A child begins at each boundary, and one more at the interval's own beginning.
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first = np.concatenate([r, lo[heads]])
    stop = np.concatenate([np.where(last, hi, np.append(r[1:], 0)[: len(r)]), r[heads]])
    of = np.concatenate([group, np.arange(len(heads))])
    order = np.lexsort((stop - first, of))
    first, stop, of = first[order], stop[order], of[order]
    small = np.append(of[1:] == of[:-1], False)[: len(of)]
    at = heads[of[small]]
    return depth[at], lo[at], hi[at], first[small], stop[small]


def _branching_squares(levels: list[np.ndarray], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of all branching squares whose period fits LEAST_TIMES times; a square may come twice."""
    n, isa = len(ids), levels[-1].astype(np.int64)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _common(levels, sa[:-1], sa[1:])
    after = np.append(ids, -1)
    depth, lo, hi, first, stop = _smaller_children(lcp, n // LEAST_TIMES)
    sizes = stop - first
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ASKED, "right")))
        part = slice(at, to)
        size = sizes[part]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i = sa[np.repeat(first[part], size) + inner]
        d, low, high = (np.repeat(x[part], size) for x in (depth, lo, hi))
        for place, other in ((i, i + d), (i - d, i - d)):
            # The other half's suffix is asked for; ``place`` is where the square begins.
            fits = np.flatnonzero((other >= 0) & (other < n))
            where = isa[other[fits]]
            found = fits[(where >= low[fits]) & (where < high[fits])]
            x, p = place[found], d[found]
            branching = after[x + p] != after[x + 2 * p]
            yield x[branching], p[branching]
        at = to


def _begin(ids: np.ndarray, at: int, period: int) -> int:
    """The first place from which every word up to ``at`` equals the one a period on."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        apart = np.flatnonzero(ids[low:at] != ids[low + period : at + period])
        if len(apart):
            return low + int(apart[-1]) + 1
        at, step = low, 2 * step
    return 0


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period."""
    width = LEAST_WORDS - LEAST_WORDS // LEAST_TIMES
    if len(ids) < LEAST_WORDS or not _repeats_a_window(ids, 1 << (width.bit_length() - 1)):
        return []
    levels = _ranks(ids)
    ends: list[np.ndarray] = []
    for x, p in _branching_squares(levels, ids):
        end, length = x + 2 * p, np.maximum(LEAST_WORDS, LEAST_TIMES * p)
        inside = np.flatnonzero(end >= length)
        end, p, length = end[inside], p[inside], length[inside]
        whole = _agree(levels, end - length, end - length + p, length - p)
        ends.append(np.stack([end[whole], p[whole]], axis=1))
    known: dict[int, list[tuple[int, int]]] = {}
    for end, period in np.unique(np.concatenate(ends), axis=0).tolist():  # smaller periods first
        mine = known.setdefault(end, [])
        if not any(period % q == 0 and end - start >= period for start, q in mine):
            mine.append((_begin(ids, end - max(LEAST_WORDS, LEAST_TIMES * period), period), period))
    return sorted((start, end - start, q) for end, mine in known.items() for start, q in mine)


def _of(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    words = (text or "").encode().split()  # at the six blanks of ASCII
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = runs_of(ids)
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        stays = np.cumsum(edge[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(stays)]
    return len(ids), runs, b" ".join(words).decode()


def periodic(text: Column | str) -> Column:
    """n_words, runs and collapsed of each whole text."""

    @F.arrow_udf(f"struct<n_words:long,runs:array<{_RUN}>,collapsed:string>")
    def of(column: pa.Array) -> pa.Array:
        found = [_of(t.as_py()) for t in column]
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f[1]] for f in found]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array(runs, pa.list_(_RUN_ARROW)), pa.array([f[2] for f in found], pa.string())],
            ["n_words", "runs", "collapsed"],
        )

    return of(text)


def find_runs(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` beside n_words, runs and collapsed of every document.

    ``runs`` are all runs (start, length, period; in words from 0) by start, then period: stretches of
    LEAST_WORDS words and LEAST_TIMES of their smallest period at least that no neighbouring word extends.
    ``collapsed`` is the text without the words of each run after its first period, joined by one blank.
    NULL or empty text: no words, no runs, the empty text. Repeated rows come out alike; an empty table gives an empty one.
    A text takes some hundred bytes of memory a word while it is worked on, one text at a time.
    """
    return docs.select(*carry, periodic("text").alias("found")).select(*carry, "found.*")


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest length / period, exactly; of equal ones the first. NULL if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
