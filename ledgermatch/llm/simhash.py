"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint. Distinct fingerprints are laid out in tiles:
a tile holds those with the same population counts of the four 16-bit quarters.
Two fingerprints differ in at least as many bits as their counts differ, quarter
by quarter, so a pair of tiles whose counts differ by more than the radius in sum
is skipped unseen; every other pair is compared completely with exclusive-or and
bit counts in numpy. Nothing is left out: the result is that of all pairs.

A fingerprint is a resident of its own tile and a visitor of the (half of the)
tiles around it, 64 at most whatever the size of the corpus; tiles with many
residents are cut into blocks by hash, and each block meets all visitors. Copies
share a fingerprint, so they take part once. A block reports the forest of its links
(fewer edges than fingerprints), never all pairs.

``near_duplicates`` labels documents, ``drop_near_duplicates`` keeps one of each group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.llm.components import connected_components
from ledgermatch.llm.shared import materialise

RADIUS = 3
SHINGLE_WORDS = 3
#: Residents of a block that are compared at once; a tile with more is cut into several blocks.
BLOCK_ROWS = 16384
#: Fingerprints on the other side of one exclusive-or.
STRIP_ROWS = 1024
SEED = 42


#: The bits of each byte value, a lane of eight bits for each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
#: Hashes whose bits are added before a lane can run over.
_LANE_ROWS = 255


def _fingerprint_bits(hashes: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of each group of hashes (heads: where it begins, none empty)."""
    chunks = -(-sizes // _LANE_ROWS)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])  # chunk of each group
    starts = np.repeat(heads, chunks) + _LANE_ROWS * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    stops = np.append(starts[1:], len(hashes))
    octets, counts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), []
    # Bits are spread out for a bounded number of hashes at a time.
    for at in range(0, len(starts), 512):
        lo, hi = starts[at], stops[min(at + 512, len(stops)) - 1]
        counts.append(np.add.reduceat(_LANES[octets[lo:hi]], starts[at : at + 512] - lo, axis=0).view(np.uint8))
    sums = np.add.reduceat(np.concatenate(counts), first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _shingle_hashes(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and how many each text has."""
    hashes, sizes = [], []
    for text in texts:
        words = (text or b"").lower().split()
        joined = b" ".join(words)
        starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
        n = max(1, len(words) - width + 1) if words else 0
        last = min(width, len(words))
        hashes += [xxhash.xxh64_intdigest(joined[starts[i] : starts[i + last] - 1], SEED) for i in range(n)]
        sizes.append(n)
    return np.array(hashes, np.uint64), np.array(sizes, np.int64)


def _fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its shingles' hashes."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        heads = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = _fingerprint_bits(hashes, heads, sizes[full])
    return out


def fingerprint(text: Column | str, width: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash (as long) of each whole text over word shingles; 0 for a text without words."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        wide, out = column.cast(pa.large_binary()), []
        # In small steps: the hashes of many long texts together would be large.
        for at in range(0, len(wide), 64):
            out.append(_fingerprints(*_shingle_hashes(wide.slice(at, 64).to_pylist(), width)))
        return pa.array(np.concatenate([np.empty(0, np.uint64), *out]).view(np.int64))

    return of(text)


# Tiles: counts of the four quarters as digits to base 32 (digits reach 16 + RADIUS, so no two tiles share a number).
_DIGITS = [1, 32, 32**2, 32**3]


def _visits(radius: int) -> list[int]:
    """Offsets to the tiles within ``radius``, one of each pair of opposite ones, without the own tile."""
    around = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= radius]
    return [sum(x * w for x, w in zip(d, _DIGITS, strict=True)) for d in around if d > (0, 0, 0, 0)]


def _tile(fp: Column) -> Column:
    quarter = lambda i: F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))
    return sum((quarter(i) * F.lit(w) for i, w in enumerate(_DIGITS)), F.lit(0))


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the edges (x, y) join what those before them left apart: a forest. ``label`` (least node of each tree) follows."""
    at, kept = np.arange(len(x)), [np.empty(0, np.int64)]
    while True:
        a, b = label[x[at]], label[y[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            return np.concatenate(kept)
        high, low = np.maximum(a, b), np.minimum(a, b)
        pick = np.full(len(label), -1)
        pick[high] = np.arange(len(at))
        trees = np.flatnonzero(pick >= 0)  # each is hung below a lesser one by one edge
        chosen = pick[trees]
        label[trees] = low[chosen]
        kept.append(at[chosen])
        while (label[label] != label).any():
            label[:] = label[label]


class _Block:
    """Residents (fingerprints) of one block and the trees that links have made of them so far."""

    def __init__(self, radius: int, residents: np.ndarray) -> None:
        self.radius, self.residents, self.label = radius, residents, np.arange(len(residents))

    def meet(self, visitors: np.ndarray | None) -> Iterator[np.ndarray]:
        """Compare every resident with every visitor (None: with each other); fingerprints (2, n) that links join."""
        own = visitors is None
        guests = self.residents if own else visitors
        n = len(self.residents)
        for at in range(0, len(guests), STRIP_ROWS):
            strip = guests[at : at + STRIP_ROWS]
            label = self.label if own else np.concatenate([self.label, n + np.arange(len(strip))])
            for lo in range(0, at + len(strip) if own else n, STRIP_ROWS):
                part = self.residents[lo : lo + STRIP_ROWS]
                i, j = np.nonzero(np.bitwise_count(part[:, None] ^ strip[None, :]) <= self.radius)
                if own:
                    ordered = lo + i < at + j
                    i, j = i[ordered], j[ordered]
                if len(i):
                    kept = _join(label, lo + i, (at if own else n) + j)
                    yield np.stack([part[i[kept]], strip[j[kept]]])
            self.label = label[:n]


def _compare(radius: int):
    """mapInArrow over rows (tile, block, visitor, fp), sorted by the first three: links (a, b) between fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, pending = None, None, []
        out: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                both = np.concatenate(out, axis=1).view(np.int64)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        def close() -> None:
            """The residents are complete: compare them with each other."""
            nonlocal block
            if pending:
                block = _Block(radius, np.concatenate(pending))
                pending.clear()
                out.extend(block.meet(None))

        for batch in batches:
            tile, part, visitor = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            items = batch.column(3).to_numpy().view(np.uint64)
            kind = np.stack([tile, part, visitor.astype(np.int64)])
            cuts = np.flatnonzero(np.any(kind[:, 1:] != kind[:, :-1], axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(items)]):
                if lo == hi:
                    continue
                if (tile[lo], part[lo]) != at:
                    close()
                    block, at = None, (tile[lo], part[lo])
                if visitor[lo]:
                    close()
                    if block:
                        out.extend(block.meet(items[lo:hi]))
                else:
                    pending.append(items[lo:hi])
            yield from flush()
        close()
        yield from flush()

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A forest (a, b) of the links between distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits.

    It has the same components as all links together.
    """
    tiled = fingerprints.select("fp", _tile(F.col("fp")).alias("tile"))
    sizes = tiled.groupBy("tile").count().select("tile", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    # At most 17 ** 4 tiles exist, so their sizes fit a broadcast at any scale; the optimizer decides from the file's size.
    sizes = materialise(sizes, "tiles")
    part = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    home = tiled.join(sizes, "tile").select("tile", part.alias("part"), F.lit(False).alias("visitor"), "fp", "blocks")
    # Blocks of the own tile: the later ones are visited, so that each two of them meet once.
    beside = home.where("blocks > 1").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "part", "fp"
    ).where("other > part").select("tile", F.col("other").alias("part"), F.lit(True).alias("visitor"), "fp")
    around = (
        tiled.select("tile", "fp", F.explode(F.array(*map(F.lit, _visits(radius)))).alias("step"))
        .select((F.col("tile") + F.col("step")).alias("tile"), "fp")
        .join(sizes, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(True).alias("visitor"), "fp")
    )
    met = home.drop("blocks").unionByName(beside).unionByName(around)
    return (
        met.repartition("tile", "part")
        .sortWithinPartitions("tile", "part", "visitor")
        .mapInArrow(_compare(radius), "a long, b long")
    )


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, fp) of every document, as a table; ``key`` tells the texts of a doc_id apart."""
    return materialise(docs.select("doc_id", F.xxhash64("text").alias("key"), fingerprint("text", width).alias("fp")), "fingerprints")


def _groups(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint, as a table.

    Both sides of the join that follows are plain tables, so a fingerprint of very many copies can be split among tasks.
    """
    first = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    label = connected_components(links(first, radius))
    labelled = first.join(label, first.fp == label.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return materialise(labelled.join(least, "component").select("fp", "component", "component_id"), "ids")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Fingerprints within ``radius`` bits are linked; component_id is the least
    doc_id that links reach, the own one included. NULL or empty text: fingerprint
    zero, linked like any other. NULL doc_id: takes part, is never the least;
    component_id is NULL if no document of the component has an id.
    Repeated rows come out as often as they came in. An empty table gives an empty one.
    """
    marked = _marked(docs, width)
    return marked.join(_groups(marked, radius), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the least doc_id, with all its columns.

    Doc_ids may be of any type that can be ordered. Documents that share one are told apart by their texts: each is
    judged in its own component, and of those of one component the one whose text has the least hash stays. Of rows that share
    doc_id and text one stays. Documents without an id take part in links and stay as they are. An empty table gives an empty one.
    """
    marked = _marked(docs, width)
    least = marked.join(_groups(marked, radius), "fp").where("doc_id = component_id")
    stays = least.groupBy("component", "doc_id").agg(F.min("key").alias("key")).select(F.col("doc_id").alias("stays"), "key").distinct()
    # Maps have neither an order nor a hash; rows that differ in nothing else are taken as equal.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    wide = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("own"), F.xxhash64(*hashed).alias("rank"))
    chosen = wide.join(stays, (F.col("doc_id") == F.col("stays")) & (F.col("own") == F.col("key")))
    # Spark limits the window's groups before the shuffle too, so repeats of one row don't meet in a task.
    turn = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("rank"))
    return (
        chosen.withColumn("turn", turn).where("turn = 1").select("row.*")
        .unionByName(wide.where("doc_id is null").select("row.*"))
    )
