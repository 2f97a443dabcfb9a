"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``WIDTH`` bytes, in most-significant-digit passes that
drop every group of one; the groups that are left at full depth are exactly the
repeated windows. The digits are laid out so that the first pass, the only one over the
whole corpus, is small:

1. The first digit of a window is its anchor: of the ``DIGIT``-byte strings inside it the
   one with the least hash. Equal windows have equal anchors at equal places, and one anchor serves
   all windows around it (some 136 bytes apart), so the pass sorts anchors, not suffixes.
   Anchors that occur once in the corpus are dropped with all their windows.
2. The second digit is what follows the anchor, the third what precedes it. For these
   the bytes around repeated anchors are dealt out by anchor and sorted within.

An anchor with places in more texts than ``GROUP_ROWS`` isn't gathered: its windows are taken in
ranges that are cut finer digit by digit, with partial counts before the shuffle. Copies of a
whole text take part once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.batches import PLAIN_WORD, Run, mix, runs, windows
from ledgermatch.llm.shared import materialise, text_key

WIDTH = 400
DIGIT = 128
#: Words of a passage, and of its anchors.
PASSAGE = 51
PASSAGE_DIGIT = 12
#: Places of one anchor that are sorted in one task.
GROUP_ROWS = 50_000
#: Parts that a range of windows around a place of a more frequent anchor is cut into at a time.
SPLIT = 5
#: Places that are sorted at once, of one anchor or of several.
SORT_ROWS = 8192
#: Bytes of one text that are worked on at once.
PIECE = 1 << 20

_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, PIECE + 2 * WIDTH), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Weighted sums of the bytes before each place, along the last axis."""
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, data.shape[-1]), axis=-1, out=out[..., 1:])
    return out


def _least(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """The least (or largest) of every ``width`` consecutive values."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, fill, np.uint64)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, width)
    head = pick.accumulate(blocks, axis=1).ravel()
    tail = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(tail[:n], head[width - 1 : width - 1 + n])


def _chosen(h: np.ndarray, bounds: np.ndarray, width: int, digit: int) -> np.ndarray:
    """Places of the least hash of every window that lies within one row; ``h`` are the hashes of ``digit`` symbols each."""
    span = width - digit + 1
    least = _least(h, span, np.minimum, 0xFFFFFFFFFFFFFFFF)
    ends = np.repeat(bounds[1:], np.diff(bounds))  # of the row of each symbol
    least[np.arange(len(least)) + width > ends[: len(least)]] = 0
    reach = np.zeros(len(h) + span - 1, np.uint64)
    reach[span - 1 : span - 1 + len(least)] = least
    return np.flatnonzero((_least(reach, span, np.maximum, 0) == h) & (np.arange(len(h)) + digit <= ends[: len(h)]))


def _anchors(data: np.ndarray, bounds: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of the windows that lie within one row."""
    n = len(data)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = _sums(data)
    with np.errstate(over="ignore"):
        h = mix((sums[digit:] - sums[:-digit]) * _powers(_BACK, n - digit + 1))
    chosen = _chosen(h, bounds, width, digit)
    return chosen, h[chosen]


def _row_anchors(column: pa.Array, width: int, digit: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    for run in runs(column, PIECE):
        if len(run.data) <= PIECE + width:
            places, h = _anchors(run.data, run.bounds, width, digit)
            cut = np.searchsorted(places, run.bounds)
            yield [(places[a:b] - s, h[a:b]) for a, b, s in zip(cut[:-1], cut[1:], run.bounds[:-1], strict=True)]
        else:  # one long text: pieces that overlap, so each window lies in one of them
            found = []
            for at in range(0, len(run.data), PIECE):
                part = run.data[at : at + PIECE + width - 1]
                places, h = _anchors(part, np.array([0, len(part)]), width, digit)
                found.append((places + at, h))
            places, h = (np.concatenate(x) for x in zip(*found, strict=True))
            places, first = np.unique(places, return_index=True)
            yield [(places, h[first])]


def anchors(text: Column | str, width: int = WIDTH, digit: int = DIGIT) -> Column:
    """Anchors (at, digit) of each whole text, as array of structs; none for fewer than ``width`` bytes."""

    @F.arrow_udf("array<struct<at:long,digit:long>>")
    def of(column: pa.Array) -> pa.Array:
        rows = list(itertools.chain.from_iterable(_row_anchors(column, width, digit)))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])]).astype(np.int32)
        places = np.concatenate([np.empty(0, np.int64), *(p for p, _ in rows)])
        hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h in rows)])
        items = pa.StructArray.from_arrays([pa.array(places), pa.array(hashes.view(np.int64))], ["at", "digit"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return of(text)


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _sort_windows(digits: np.ndarray, lefts: np.ndarray, contexts: list[bytes], width: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second and third pass over the windows around anchors: stretches (context, first, last) of repeated ones.

    A window is numbered by the bytes it has before its anchor. Windows of one number are sorted together,
    so the work holds a few values per context, however many windows those have.
    """
    reach, n = width - digit, len(contexts)
    sizes = np.array([len(c) for c in contexts])
    rights = sizes - lefts - digit
    table = np.zeros((n, 2 * reach + digit), np.uint8)  # the anchors stand below each other
    column = np.arange(table.shape[1])
    table[(column >= (reach - lefts)[:, None]) & (column < (reach - lefts + sizes)[:, None])] = np.frombuffer(b"".join(contexts), np.uint8)
    before, after = np.ascontiguousarray(table[:, :reach].T), np.ascontiguousarray(table[:, reach + digit :].T)
    power, base, one = _powers(_BASE, reach + 1), np.uint64(_BASE), np.uint64(1)
    hit = np.zeros((n, reach + 3), bool)
    with np.errstate(over="ignore"):
        first = mix(digits.view(np.uint64) * base)
        left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(reach):
            right += (after[k].astype(np.uint64) + one) * power[k]
        for o in range(reach + 1):
            rows = np.flatnonzero((lefts >= o) & (rights >= reach - o))
            keys = mix(first[rows] + mix(right[rows]))
            stay = _repeated(keys)
            rows, keys = rows[stay], keys[stay]
            hit[rows[_repeated(mix(keys * base + mix(left[rows])))], o + 1] = True
            if o < reach:
                left = left * base + (before[reach - 1 - o].astype(np.uint64) + one)
                right -= (after[reach - 1 - o].astype(np.uint64) + one) * power[reach - 1 - o]
    who, begin = np.nonzero(hit[:, 1:] & ~hit[:, :-1])
    _, end = np.nonzero(hit[:, :-1] & ~hit[:, 1:])
    return who, begin, end - 1


_PART = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _sort_groups(width: int, digit: int):
    """mapInArrow over (digit, key1, key2, at, left, context) sorted by digit: repeated stretches (key1, key2, lo, hi)."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        who, first, last = _sort_windows(column("digit"), column("left"), table.column("context").to_pylist(), width, digit)
        at = column("at")[who]
        return pa.RecordBatch.from_arrays(
            [pa.array(column("key1")[who]), pa.array(column("key2")[who]), pa.array(at - last), pa.array(at - first + width)], schema=_PART
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            digits = batch.column("digit").to_numpy()
            for lo in range(0, len(digits), SORT_ROWS):
                part = batch.slice(lo, SORT_ROWS)
                own = part.column("digit").to_numpy()
                # All groups that end before the last one of this part are complete.
                cut = int(np.searchsorted(own == own[-1], True)) if len(own) else 0
                held = sum(b.num_rows for b in waiting)
                if cut == 0 and waiting and waiting[-1].column("digit")[-1].as_py() == own[0]:
                    waiting.append(part)
                    continue
                waiting.append(part.slice(0, cut))
                if held + cut >= SORT_ROWS:
                    yield solve(waiting)
                    waiting = []
                waiting.append(part.slice(cut))
        waiting = [b for b in waiting if b.num_rows]
        if waiting:
            yield solve(waiting)

    return run


def _place() -> Column:
    return F.xxhash64("key1", "key2", "at")


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    """Each row's range of windows cut into ranges of ``width``, with the digits that all windows of a range share hashed in."""
    lo, hi = F.col("p.lo"), F.col("p.hi")
    cut = F.transform(
        F.sequence(F.col("lo"), F.col("hi"), F.lit(width)),
        lambda x: F.struct(x.alias("lo"), F.least(x + (width - 1), F.col("hi")).alias("hi")),
    )
    # Ranges of which at least one window lies within the text.
    real = F.filter(cut, lambda p: (p["lo"] <= F.col("lo") + F.length("l")) & (p["hi"] >= F.col("hi") - F.length("r")))
    each = rows.select("*", F.explode(real).alias("p"))
    near = lo - F.col("lo")  # bytes before the anchor that the range's windows share, beyond those already hashed
    far = F.col("hi") - hi  # and after it
    shared = [F.substring("l", F.length("l") - near + 1, near), F.substring("r", F.lit(1), far)]
    begin = F.greatest(F.lit(0), F.length("l") - (hi - F.col("lo")))
    return each.select(
        "key1", "key2", "at", lo.alias("lo"), hi.alias("hi"),
        F.xxhash64("c1", lo, *shared).alias("c1"), F.xxhash64("c2", lo, *shared).alias("c2"),
        F.substring("l", begin + 1, F.length("l") - near - begin).alias("l"), F.substring("r", far + 1, hi - lo).alias("r"),
    )


def _twice(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Values of the hashes ``a`` and ``b`` that two places or more have, with the hash of one of the places."""
    return rows.groupBy(a, b).agg(F.min(_place()).alias("witness"), F.max(_place()).alias("other")).where("witness <> other").select(a, b, "witness")


def _descend(hot: DataFrame, width: int, digit: int) -> list[DataFrame]:
    """Repeated stretches (key1, key2, lo, hi) around anchors with many places, without gathering any anchor.

    A row stands for a range of the windows around one place. What all windows of the range share
    is hashed, what only some of them hold is kept as bytes. If another place has all the bytes, every window of the
    range is repeated and the row is done (one row of each such group goes on, as a witness for places that
    share less); if no place shares the common part, no window is repeated and the row goes; else the range is cut and the next
    digits are hashed. A row has a few parts at each level, not one per window.
    """
    reach = width - digit
    rows = hot.select(
        "key1", "key2", "at", F.lit(0).alias("lo"), F.lit(reach).alias("hi"), F.xxhash64("digit").alias("c1"), F.xxhash64(F.lit(1), "digit").alias("c2"),
        F.substring("context", F.lit(1), F.col("left").cast("int")).alias("l"),
        F.substring("context", (F.col("left") + digit + 1).cast("int"), F.lit(reach)).alias("r"),
    )
    out, step = [], reach + 1
    while True:
        rows = materialise(rows, f"ranges{step}")
        whole = (F.length("l") == F.col("hi") - F.col("lo")) & (F.length("r") == F.col("hi") - F.col("lo"))
        full = rows.withColumn("f1", F.when(whole, F.xxhash64("c1", "l", F.lit(0), "r"))).withColumn("f2", F.when(whole, F.xxhash64("c2", "l", F.lit(0), "r")))
        equal = _twice(full.where("f1 is not null"), "f1", "f2")
        # Both sides are plain tables and rows without hashes stay out of the join, so that hot values can be split among tasks.
        known = full.where("f1 is not null").join(materialise(equal, f"equal{step}"), ["f1", "f2"], "left")
        partial = full.where("f1 is null").withColumn("witness", F.lit(None).cast("long"))
        judged = materialise(known.unionByName(partial).drop("f1", "f2"), f"judged{step}")
        out.append(judged.where("witness is not null").select("key1", "key2", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + width).alias("hi")))
        if step == 1:
            return out
        step = -(-step // SPLIT)
        # Of rows that are done one goes on, for those that share only a part with them.
        parts = materialise(_pieces(judged.where(F.col("witness").isNull() | (F.col("witness") == _place())), step), f"parts{step}")
        rows = parts.join(materialise(_twice(parts, "c1", "c2"), f"shared{step}"), ["c1", "c2"], "left_semi")


def _words(column: pa.Array, width: int, digit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run of rows: word hashes, each row's first word, places of the anchors of ``width`` words, hashes of ``digit`` words each."""
    for run in runs(column, PIECE):
        if len(run.data) <= PIECE:
            words = run.pieces(PLAIN_WORD[run.data])
            hashes, bounds = words.hashes(), words.firsts()
        else:  # one long text: its words are hashed in parts that end at a blank
            blanks = np.flatnonzero(~PLAIN_WORD[run.data])
            cuts = blanks[np.searchsorted(blanks, np.arange(PIECE, blanks[-1], PIECE))] if len(blanks) else blanks
            parts = [Run(x, np.array([0, len(x)])) for x in np.split(run.data, np.unique(cuts))]
            hashes = np.concatenate([x.pieces(PLAIN_WORD[x.data]).hashes() for x in parts])
            bounds = np.array([0, len(hashes)])
        if len(hashes) < width:
            yield hashes, bounds, np.empty(0, np.int64), np.empty(0, np.uint64)
        else:
            short = windows(hashes, digit)
            yield hashes, bounds, _chosen(short, bounds, width, digit), short


def _lists(parts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Offsets of the rows' lists, and what they hold."""
    return pa.array(np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.empty(0, np.int64)]))]).astype(np.int32)), np.concatenate([np.empty(0, np.uint64), *parts])


def word_anchors(text: Column | str, width: int, digit: int) -> Column:
    """Hashes of the anchors of each whole text's windows of ``width`` words; none for fewer words."""

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        parts, sizes = [], []
        for _, bounds, places, short in _words(column, width, digit):
            parts.append(short[places])
            sizes.append(np.diff(np.searchsorted(places, bounds)))
        offsets, found = _lists(parts, sizes)
        return pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64)))

    return of(text)


def word_windows(text: Column | str, digits: Column | str, width: int, digit: int, middle: bool) -> Column:
    """Hashes (h1, h2) of the windows of ``width`` words around those anchors of a text whose hash is in ``digits``.

    With ``middle`` one window of each anchor, that with the anchor in its middle (or as near as the text allows).
    """
    reach = width - digit

    @F.arrow_udf("array<struct<h1:long,h2:long>>")
    def of(column: pa.Array, wanted: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        asked = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        first, second, sizes, row = [], [], [], 0
        for hashes, bounds, places, short in _words(column, width, digit):
            rows = len(bounds) - 1
            cut = np.searchsorted(places, bounds)
            own, stay = np.repeat(np.arange(rows), np.diff(cut)), np.zeros(len(places), bool)
            for r in np.flatnonzero(np.diff(cut)):
                stay[cut[r] : cut[r + 1]] = np.isin(short[places[cut[r] : cut[r + 1]]], asked[ends[row + r] : ends[row + r + 1]])
            row += rows
            places, own = places[stay], own[stay]
            lo, hi = np.maximum(bounds[own], places - reach), np.minimum(places, bounds[own + 1] - width)
            if middle:
                starts = np.unique(np.clip(places - reach // 2, lo, hi))
            else:
                n = hi - lo + 1
                starts = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
            sizes.append(np.diff(np.searchsorted(starts, bounds)))
            if len(starts):
                first.append(windows(hashes, width)[starts])
                second.append(short[starts])
        offsets, h1 = _lists(first, sizes)
        h2 = np.concatenate([np.empty(0, np.uint64), *second])
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["h1", "h2"]))

    return of(text, digits)


_TEXT = ["key1", "key2"]


def _in_two(rows: DataFrame, *columns: str) -> DataFrame:
    """Values that rows of different texts have."""
    different = (F.min("key1") != F.max("key1")) | (F.min("key2") != F.max("key2"))
    return rows.groupBy(*columns).agg(different.alias("different")).where("different").select(*columns)


def _sharing(candidates: DataFrame, width: int, digit: int) -> DataFrame:
    """Texts (key1, key2) that have ``width`` consecutive words of another text, of those with repeated anchors (digits).

    One window of each anchor tells it of most texts. All windows are compared only around anchors of texts that
    are still open, in whichever texts these anchors are.
    """
    some = candidates.where("digits is not null")

    def found(rows: DataFrame, middle: bool) -> DataFrame:
        hashed = materialise(rows.select(*_TEXT, F.inline(word_windows("text", "digits", width, digit, middle))), "windows")
        return materialise(hashed.join(materialise(_in_two(hashed, "h1", "h2"), "both"), ["h1", "h2"], "left_semi").select(*_TEXT).distinct(), "sharing")

    known = found(some, True)
    listed = some.select(*_TEXT, F.explode("digits").alias("digit"))
    asked = materialise(listed.join(known, _TEXT, "left_anti").select("digit").distinct(), "asked")
    narrowed = listed.join(asked, "digit", "left_semi").groupBy(*_TEXT).agg(F.collect_set("digit").alias("digits"))
    rest = some.drop("digits").join(materialise(narrowed, "narrowed"), _TEXT)
    return known.unionByName(found(rest, False)).distinct()


_SPANS = "array<struct<lo:long,hi:long>>"


@F.arrow_udf(T.StructType().add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("lo", "long").add("hi", "long"))).add("kept_sha256", "string"))
def cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The united spans of each text, their bytes, and the hash of the bytes that are left."""
    rows = []
    for content, listed in zip(text.cast(pa.large_binary()), spans.to_pylist(), strict=True):
        view, digest, at, united = memoryview(content.as_py() or b""), hashlib.sha256(), 0, []
        for span in sorted(listed, key=lambda s: (s["lo"], s["hi"])):
            if united and span["lo"] <= united[-1]["hi"]:
                united[-1]["hi"] = max(united[-1]["hi"], span["hi"])
            else:
                united.append(dict(span))
        for span in united:
            digest.update(view[at : span["lo"]])
            at = span["hi"]
        digest.update(view[at:])
        rows.append({"n_removed": sum(s["hi"] - s["lo"] for s in united), "spans": united, "kept_sha256": digest.hexdigest()})
    kind = pa.struct([("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept_sha256", pa.string())])
    return pa.array(rows, kind)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, digit: int = DIGIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of bytes, united, end exclusive), kept_sha256 and shares_passage of every document.

    A byte is removed if a string of ``width`` bytes that covers it also starts anywhere else, in another
    text or the same. NULL text counts as empty. NULL doc_id changes nothing. Repeated rows are copies
    of each other and lose all bytes if there are ``width`` of them or more.

    ``shares_passage`` tells whether ``PASSAGE`` consecutive words stand in another document too, however few
    bytes they have; nothing is removed for it.
    """
    if not 0 < digit <= width:
        raise ValueError("digit lies between 1 and width")
    text = F.coalesce("text", F.lit(""))
    narrow = materialise(
        docs.select("doc_id", *text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "texts"
    )
    texts = narrow.groupBy("key1", "key2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))

    # First pass: anchors that occur at two places or more.
    keyed = docs.select("doc_id", *text_key(text), text.alias("text"))
    every = materialise(
        keyed.where(F.octet_length("text") >= width).select("key1", "key2", F.inline(anchors("text", width, digit))), "anchors"
    )
    often = every.groupBy("digit").agg(F.min(_place()).alias("a"), F.max(_place()).alias("b")).where("a <> b").select("digit")
    # Both sides of the join are plain tables, so an anchor with very many places can be split among tasks.
    chosen = every.join(materialise(often, "often"), "digit").groupBy("key1", "key2").agg(F.collect_set(F.struct("at", "digit")).alias("anchors"))

    # The same over words, for passages: anchors that two texts have.
    worded = materialise(keyed.where(F.octet_length("text") >= 2 * PASSAGE - 1).select(*_TEXT, word_anchors("text", PASSAGE, PASSAGE_DIGIT).alias("digits")), "words")
    every_word = worded.select(*_TEXT, F.explode("digits").alias("digit"))
    in_two = materialise(_in_two(every_word, "digit"), "in_two")
    chosen = chosen.join(every_word.join(in_two, "digit").groupBy(*_TEXT).agg(F.collect_set("digit").alias("digits")), _TEXT, "full")

    # One row of each text that has any, fetched by the doc_id of that row, so copies don't meet in one task.
    wanted = chosen.join(texts.drop("copies"), ["key1", "key2"]).select(
        F.col("key1").alias("of1"), F.col("key2").alias("of2"), "one", "anchors", "digits"
    )
    same = (F.col("key1") == F.col("of1")) & (F.col("key2") == F.col("of2")) & F.col("doc_id").eqNullSafe(F.col("one"))
    candidates = materialise(keyed.join(wanted, same).select("key1", "key2", "text", "anchors", "digits"), "candidates")
    copied = worded.where(F.size("digits") > 0).groupBy(*_TEXT).count().where("count > 1").select(*_TEXT)
    sharing = _sharing(candidates, PASSAGE, PASSAGE_DIGIT).unionByName(copied).distinct().withColumn("shares", F.lit(True))

    # Second and third pass: the bytes around each such anchor.
    left = F.least(F.col("a.at"), F.lit(width - digit).cast("long"))
    around = (
        candidates.select("key1", "key2", F.encode("text", "utf-8").alias("content"), F.explode("anchors").alias("a"))
        .select("key1", "key2", F.col("a.at").alias("at"), F.col("a.digit").alias("digit"), left.alias("left"), "content")
        .select(
            "digit", "key1", "key2", "at", "left",
            F.substring("content", (F.col("at") - F.col("left") + 1).cast("int"), (F.col("left") + width).cast("int")).alias("context"),
        )
    )
    places = candidates.select(F.explode("anchors.digit").alias("digit")).groupBy("digit").count()
    frequent = materialise(places.where(F.col("count") > group_rows).select("digit"), "frequent")
    hot = around.join(frequent, "digit", "left_semi")
    few = around.join(frequent, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit")
    parts = few.mapInArrow(_sort_groups(width, digit), "key1 long, key2 long, lo long, hi long")
    for more in _descend(hot, width, digit):
        parts = parts.unionByName(more)
    spans = parts.groupBy("key1", "key2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = candidates.select("key1", "key2", "text").join(spans, ["key1", "key2"]).select("key1", "key2", cut_out("text", "spans").alias("cut"))
    cut = materialise(cut.dropDuplicates(["key1", "key2"]), "cut")

    per_text = texts.select("key1", "key2", "copies").join(cut, ["key1", "key2"], "left").join(sharing, _TEXT, "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    pick = lambda gone, some, none: F.when(all_gone, gone).when(F.col("cut").isNotNull(), some).otherwise(none)
    return narrow.join(per_text, ["key1", "key2"]).select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("cut.n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(whole, F.col("cut.spans"), F.array().cast(_SPANS)).alias("spans"),
        pick(F.sha2(F.lit(""), 256), F.col("cut.kept_sha256"), F.col("sha")).alias("kept_sha256"),
        F.coalesce("shares", F.lit(False)).alias("shares_passage"),
    )
