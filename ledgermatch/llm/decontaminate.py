"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The benchmark's windows of words form a hash set that every task holds; the
corpus is scanned once, all windows of a batch of texts hashed together in numpy,
and each hit is verified word by word. Only sets of a checked size are broadcast
(``SET_BYTES`` bytes); a larger benchmark is cut into that many sets and the
corpus scanned once per set, with the hits so far written in between. The result is the
same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.batches import LOWER, STRICT_WORD, Run, runs, windows
from ledgermatch.llm.shared import materialise

WINDOW_WORDS = 10
#: Bytes of one broadcast set at most, as its rows are estimated; a set is one pass over the documents.
SET_BYTES = 128 << 20
#: Estimated bytes of a window and of an item's id beside their texts.
ROW_BYTES, ID_BYTES = 400, 80
#: Items in a row of a window, about; a window of more has several rows, which may be in several sets.
ROW_ITEMS = 1000

_UPPER_TEXT, _LOWER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FILTER = 1 << 22


def grams(benchmark: DataFrame, width: int, row_items: int) -> DataFrame:
    """Windows (gram, n_words, part, items) of the benchmark; an item of fewer words is one window.

    The items of a window are dealt out to as many rows as ``row_items`` asks for, however many share it.
    """
    words = F.regexp_extract_all(F.translate("text", _UPPER_TEXT, _LOWER_TEXT), F.lit(_WORD), F.lit(0))
    listed = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1)))
    each = listed.select("item", "words", at.alias("at")).select("item", F.slice("words", F.col("at"), F.lit(width)).alias("gram"))
    parts = max(1, math.ceil(benchmark.count() / row_items))
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")
    return each.groupBy(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n_words"), part).agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


class GramSet:
    """A set of windows with the items of each, to be looked up by hash and then by words."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str]] = {}
        for row in rows:
            self.items.setdefault(row.gram.encode(), []).extend(row["items"])
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list[str]] = {}
        for row in rows:
            by_width.setdefault(row.n_words, []).append(row.gram)
        for width, texts in by_width.items():
            found = []
            for run in runs(pa.array(texts, pa.large_string())):
                words = run.pieces(STRICT_WORD[run.data])
                found.append(windows(words.hashes(), width)[words.firsts()[:-1]])
            known = np.unique(np.concatenate(found))
            likely = np.zeros(_FILTER, bool)
            likely[known & np.uint64(_FILTER - 1)] = True
            self.by_width[width] = known, np.packbits(likely)

    def scan(self, run: Run) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Words, merged hit ranges of words and items of each row."""
        data = LOWER[run.data]
        words = run.pieces(STRICT_WORD[data])
        first = words.firsts()
        sizes = np.diff(first)
        row = np.repeat(np.arange(run.rows), sizes)
        hashes = words.hashes(data)
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(run.rows)]
        items: list[set[str]] = [set() for _ in range(run.rows)]
        content = data.tobytes()
        for width, (known, packed) in self.by_width.items():
            h = windows(hashes, width)
            if not len(h):
                continue
            low = (h & np.uint64(_FILTER - 1)).astype(np.int64)
            at = np.flatnonzero((packed[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            at = at[(known[place] == h[at]) & (row[at] == row[at + width - 1])]
            for i in at.tolist():
                stretch = zip(words.starts[i : i + width].tolist(), words.stops[i : i + width].tolist(), strict=True)
                listed = self.items.get(b" ".join(content[a:b] for a, b in stretch))
                if listed is not None:
                    r = row[i]
                    ranges[r].append((int(i - first[r]), int(i - first[r]) + width))
                    items[r].update(listed)
        return [(int(n), _merged(x), sorted(y)) for n, x, y in zip(sizes, ranges, items, strict=True)]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


_RANGES = "array<struct<lo:long,hi:long>>"
_RANGES_TYPE = T.ArrayType(T.StructType().add("lo", "long").add("hi", "long"))
_ARROW_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("ranges", _ARROW_RANGES), ("items", pa.list_(pa.string()))])


def _ranges_array(rows: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"lo": lo, "hi": hi} for lo, hi in row] for row in rows]


@F.arrow_udf(_RANGES_TYPE)
def merge_ranges(ranges: pa.Array) -> pa.Array:
    """Ranges of a row united where they touch."""
    return pa.array(_ranges_array([_merged([(x["lo"], x["hi"]) for x in row]) for row in ranges.to_pylist()]), _ARROW_RANGES)


def _finder(known) -> Column:
    @F.arrow_udf(f"struct<n_words:long,ranges:{_RANGES},items:array<string>>")
    def find(text: pa.Array) -> pa.Array:
        rows = [x for run in runs(text) for x in known.value.scan(run)]
        return pa.array([{"n_words": n, "ranges": r, "items": i} for (n, _, i), r in zip(rows, _ranges_array([x[1] for x in rows]), strict=True)], _ARROW_FOUND)

    return find(F.col("text"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *carry: str, width: int = WINDOW_WORDS, set_bytes: int = SET_BYTES) -> DataFrame:
    """Columns ``carry``, text, n_words, ranges (merged hit ranges of words) and items of every document.

    Windows are broadcast in sets of ``set_bytes`` at most, a pass over the documents each. NULL or empty text: no words, nothing found. A benchmark item without words has
    no window; one without item_id marks words, but has no id to list. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    table = materialise(grams(benchmark, width, ROW_ITEMS), "grams")
    ids = F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + ID_BYTES)
    total = table.agg(F.sum(F.lit(ROW_BYTES) + F.octet_length("gram") + ids)).first()[0] or 0
    sets = max(1, math.ceil(total / set_bytes))
    out = docs.select(*carry, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_RANGES).alias("ranges"), F.array().cast("array<string>").alias("items"))
    for k in range(sets):
        known = spark.sparkContext.broadcast(GramSet(table.where(F.pmod(F.xxhash64("gram", "part"), F.lit(sets)) == k).collect()))
        found = out.withColumn("found", _finder(known))
        merged = F.col("found.ranges") if sets == 1 else merge_ranges(F.concat("ranges", "found.ranges"))
        out = found.select(
            *carry, "text", F.col("found.n_words").alias("n_words"), merged.alias("ranges"), F.array_union("items", "found.items").alias("items")
        )
        if k + 1 < sets:
            out = materialise(out, f"found{k}")
            known.destroy()
    return out


@F.arrow_udf(T.StringType())
def without_words(text: pa.Array, ranges: pa.Array) -> pa.Array:
    """The text without the given ranges of words and what stands between them; NULL stays NULL."""
    out, at = [], 0
    spans = ranges.to_pylist()
    for run in runs(text):
        words = run.pieces(STRICT_WORD[LOWER[run.data]])
        first = words.firsts()
        for r in range(run.rows):
            part, lo = [], int(run.bounds[r])
            for span in spans[at]:
                part.append(run.data[lo : words.starts[first[r] + span["lo"]]].tobytes())
                lo = int(words.stops[first[r] + span["hi"] - 1])
            part.append(run.data[lo : run.bounds[r + 1]].tobytes())
            out.append(b"".join(part).decode("utf-8", "replace") if text[at].is_valid else None)
            at += 1
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents without benchmark passages, with all their columns.

    ``remove="documents"`` drops every document with a hit, ``"spans"`` cuts the hit
    words out of its text. Rows without a hit come out as they are, repeated or not.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = find_benchmark(docs.select(F.struct("*").alias("row"), "text"), benchmark, "row")
    if remove == "documents":
        return found.where("size(ranges) = 0").select("row.*")
    cut = F.when(F.size("ranges") > 0, without_words("text", "ranges")).otherwise(F.col("text"))
    return found.select(F.col("row").withField("text", cut).alias("row")).select("row.*")
