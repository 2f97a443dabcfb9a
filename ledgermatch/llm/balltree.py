"""Exact ranked search by ball trees over sparse term vectors.

A document is the vector of its terms' integer scores, a query the vector of its term counts, the
rank of a document their inner product. Of the terms only those of the queries matter, so a
document shrinks to a short list of them in one scan.

Every task builds ball trees over some thousand documents each: a node keeps the centroid and the radius of
its documents, halves are cut along the line between two far points. A query descends best-first; no document of a
node can score more than the query's product with the centroid plus the query's length
times the radius, so a subtree whose bound is below the k-th score found so far is never
looked into. Bounds are doubles rounded up by far more than their error; scores at the leaves are whole
numbers. The k best of a task carry over from tree to tree and only they leave it.

One radius over all terms rules out nothing: two texts always lie far apart in some terms. So a
node has a radius per group of terms, and the bound adds the query's length in a group times the radius
there (a ball in each group's space). Terms of one query only make a group together, a term of several queries
is one by itself. On 10 000 documents and 200 queries that leaves a third of the leaves to be read. Bounds hold for any
split of a term's weight between query and document; half of it (its square root) on each side reads fewest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgermatch.llm.shared import materialise

TOP = 20
#: Documents of a tree and entries of their vectors at most (a single document may have more), documents of a leaf.
TREE_ROWS, TREE_ENTRIES, LEAF_ROWS = 16384, 1 << 21, 24
#: Terms of the queries that are searched for in one pass.
BLOCK_TERMS = 200_000
#: Relative room for the error of doubles in bounds; a sum of a million terms errs by 1e-10 of its size at most.
ROUNDING = 1e-8

# --- fixed values: constants of the score ---
LENGTH_SHARE, SATURATION, SCALE = 25, 12, 1_000_000_000
# --- end of fixed values ---

#: Bytes of terms, A-Z in lower case; all others become blanks.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def terms(text: pa.Array) -> pa.Array:
    """The terms of each whole text in order; none for NULL."""
    return pa.array([_terms(t.as_py()) for t in text], pa.list_(pa.binary()))


def term_counts(text: Column | str, vocabulary: list[bytes]) -> Column:
    """n (terms of each whole text), the places in ``vocabulary`` of the terms that are in it, ascending, and how often each occurs."""
    places = {t: i for i, t in enumerate(vocabulary)}

    @F.arrow_udf("struct<n:long,term:array<int>,tf:array<int>>")
    def of(column: pa.Array) -> pa.Array:
        n, found, counts, offsets = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
        for t in column:
            words = _terms(t.as_py())
            ids, tf = np.unique(np.array([p for w in words if (p := places.get(w)) is not None], np.int64), return_counts=True)
            n.append(len(words))
            found.append(ids)
            counts.append(tf)
            offsets.append(offsets[-1] + len(ids))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (found, counts)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists], ["n", "term", "tf"])

    return of(text)


class _Tree:
    """A ball tree over the rows of a sparse matrix (none empty), with exact values beside the scaled ones."""

    def __init__(self, indptr: np.ndarray, cols: np.ndarray, values: np.ndarray, scaled: np.ndarray, group: np.ndarray) -> None:
        width = len(group)
        self.group = group
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []  # of each node, in ``order``
        self.scratch = np.zeros(width)
        sizes = np.diff(indptr)
        squares = np.add.reduceat(scaled * scaled, indptr[:-1])
        self.order = np.arange(len(sizes))
        todo = [(0, len(sizes), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node, mine = len(self.rows), self.order[lo:hi]
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            size = sizes[mine]
            heads = np.cumsum(size) - size
            entries = np.repeat(indptr[mine] - heads, size) + np.arange(size.sum())
            at, x, xx = cols[entries], scaled[entries], squares[mine]
            centre = np.bincount(at, weights=x, minlength=width) / len(mine)
            cc = float(centre @ centre)
            apart = xx - 2 * np.add.reduceat(x * centre[at], heads) + cc
            used = np.flatnonzero(centre)
            self.centroids.append((used, centre[used]))
            self.radii.append(self._spread(at, x, centre, heads, len(mine)))
            self.rows.append((lo, hi))
            self.children.append(None)
            if len(mine) <= LEAF_ROWS or float(apart.max()) <= ROUNDING * cc:
                continue
            a = int(apart.argmax())
            to_a = np.add.reduceat(x * self._dense(at, x, heads, size, a)[at], heads)
            self._clear(at, heads, size, a)
            b = int((xx - 2 * to_a).argmax())
            to_b = np.add.reduceat(x * self._dense(at, x, heads, size, b)[at], heads)
            self._clear(at, heads, size, b)
            half = len(mine) // 2
            self.order[lo:hi] = mine[np.argpartition(to_b - to_a, half)]
            todo += [(lo, lo + half, node, 0), (lo + half, hi, node, 1)]
        # Rows in the order of leaves, so that a leaf is one stretch.
        size = sizes[self.order]
        self.heads = np.append(np.cumsum(size) - size, size.sum())
        entries = np.repeat(indptr[self.order] - self.heads[:-1], size) + np.arange(size.sum())
        self.cols, self.values = cols[entries], values[entries]

    def _dense(self, at: np.ndarray, x: np.ndarray, heads: np.ndarray, size: np.ndarray, row: int) -> np.ndarray:
        part = slice(heads[row], heads[row] + size[row])
        self.scratch[at[part]] = x[part]
        return self.scratch

    def _clear(self, at: np.ndarray, heads: np.ndarray, size: np.ndarray, row: int) -> None:
        self.scratch[at[heads[row] : heads[row] + size[row]]] = 0.0

    def _spread(self, at: np.ndarray, x: np.ndarray, centre: np.ndarray, heads: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups in which rows have entries, and how far from the centroid a row lies in each at most, rounded up."""
        group = self.group[at]
        first = np.ones(len(at), bool)
        first[1:] = group[1:] != group[:-1]
        first[heads] = True
        starts = np.flatnonzero(first)
        mine = group[starts]
        own, moved = np.add.reduceat(x * x, starts), np.add.reduceat(x * (x - 2 * centre[at]), starts)
        order = np.argsort(mine, kind="stable")
        mine = mine[order]
        cuts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        farthest, largest = np.maximum.reduceat(moved[order], cuts), np.maximum.reduceat(own[order], cuts)
        lacking = np.diff(np.append(cuts, len(mine))) < rows  # a row without entries lies as far as the centroid is long
        farthest[lacking] = np.maximum(farthest[lacking], 0.0)
        used = mine[cuts]
        length = np.bincount(self.group, weights=centre * centre)[used]
        # What cancels in the sum may be wrong by a rounding of its parts.
        return used, np.sqrt(np.maximum(0.0, farthest + length + ROUNDING * (largest + length)))

    def scores(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their exact products with a dense query of whole numbers."""
        lo, hi = self.rows[node]
        first = self.heads[lo]
        part = slice(first, self.heads[hi])
        return self.order[lo:hi], np.add.reduceat(query[self.cols[part]] * self.values[part], self.heads[lo:hi] - first)

    def bound(self, node: int, query: np.ndarray, lengths: np.ndarray) -> float:
        """No row of the node has a product with ``query`` (whose length in each group is given) above this."""
        used, centre = self.centroids[node]
        groups, radius = self.radii[node]
        return (float(query[used] @ centre) + float(lengths[groups] @ radius)) * (1 + ROUNDING)


@dataclass
class Queries:
    """Items of one pass: the places and counts of each one's terms; weight and group of each term."""

    items: list[int]
    vectors: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    group: np.ndarray
    n_docs: int
    n_terms: int
    top: int

    def matrix(self, n: np.ndarray, cols: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact value of each entry, and the value without half of its weight."""
        m = np.repeat(100 - LENGTH_SHARE + LENGTH_SHARE * n * self.n_docs // max(1, self.n_terms), sizes)
        part = SCALE * tf // (1000 * tf + SATURATION * m)
        return self.weights[cols] * part, np.sqrt(self.weights[cols]) * part


def _better(best: list[tuple], top: int) -> int:
    """The least score that can still enter."""
    return best[-1][0] * -1 if len(best) == top else 1


def _descend(tree: _Tree, ids: list[list], dense: np.ndarray, exact: np.ndarray, lengths: np.ndarray, best: list[tuple], top: int) -> int:
    """Best-first: ``best`` (-score, id is NULL, id), sorted, takes what the tree has. Returns how many leaves were read."""
    heap, read = [(-tree.bound(0, dense, lengths), 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        least = _better(best, top)
        if -bound < least:
            break
        pair = tree.children[node]
        if pair:
            for child in pair:
                b = tree.bound(child, dense, lengths)
                if b >= least:
                    heapq.heappush(heap, (-b, child))
            continue
        read += 1
        rows, scores = tree.scores(node, exact)
        new = [(-int(scores[i]), doc is None, doc) for i in np.flatnonzero(scores >= least) for doc in ids[rows[i]]]
        if new:
            best += new
            best.sort(key=_order)
            del best[top:]
    return read


def _order(found: tuple) -> tuple:
    return found[:2] if found[1] else found


def _search(queries: Queries, out: pa.Schema):
    """mapInArrow over rows (doc_id, n, term, tf): (item, doc_id, score) of the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(queries.weights)
        best: list[list[tuple]] = [[] for _ in queries.items]
        dense, exact = np.zeros(width), np.zeros(width, np.int64)
        held: list[tuple] = []  # (n, terms, counts, ids) of different vectors
        places: dict[tuple, int] = {}
        entries = 0

        def plant() -> None:
            nonlocal entries
            sizes = np.array([len(h[1]) for h in held])
            cols, tf = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (1, 2))
            values, scaled = queries.matrix(np.array([h[0] for h in held], np.int64), cols, tf, sizes)
            tree = _Tree(np.append(0, np.cumsum(sizes)), cols, values, scaled, queries.group)
            # Of documents with one vector no more than ``top`` can be among the best.
            ids = [sorted(h[3], key=lambda d: (d is None, d) if d is not None else (True,))[: queries.top] for h in held]
            for (term, count), found in zip(queries.vectors, best, strict=True):
                dense[term], exact[term] = np.sqrt(queries.weights[term]) * count, count
                _descend(tree, ids, dense, exact, np.sqrt(np.bincount(queries.group, weights=dense * dense)), found, queries.top)
                dense[term], exact[term] = 0.0, 0
            held.clear()
            places.clear()
            entries = 0

        for batch in batches:
            doc_ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            term, tf = batch.column(2), batch.column(3)
            offsets, all_terms, all_tf = term.offsets.to_numpy(), term.values.to_numpy(), tf.values.to_numpy()
            shift = tf.offsets.to_numpy()
            for i, doc_id in enumerate(doc_ids):
                a, b = (x[off[i] : off[i + 1]] for x, off in ((all_terms, offsets), (all_tf, shift)))
                key = (int(n[i]), a.tobytes(), b.tobytes())
                at = places.setdefault(key, len(held))
                if at < len(held):
                    held[at][3].append(doc_id)
                else:
                    held.append((key[0], a, b, [doc_id]))
                    entries += len(a)
                    if len(held) >= TREE_ROWS or entries >= TREE_ENTRIES:
                        plant()
        if held:
            plant()
        rows = [(item, f[2], -f[0]) for item, found in zip(queries.items, best, strict=True) for f in found]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def _blocked(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Items with the block of each; a block has ``limit`` terms at most, unless it is one item."""
    total = items.agg(F.sum("n_terms")).first()[0] or 0
    blocks = max(1, -(-total // limit))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        worst = dealt.groupBy("block").agg(F.sum("n_terms").alias("n"), F.count("*").alias("items")).where((F.col("n") > limit) & (F.col("items") > 1))
        if worst.isEmpty():
            return dealt, blocks
        blocks = 2 * blocks + 1


def _vocabulary(asked: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The terms of all queries, and the group of each; a group's terms stand together."""
    owner: dict[bytes, int] = {}
    for i, its in enumerate(asked):
        for t in set(its):
            owner[t] = i if t not in owner else -1
    listed = sorted(owner, key=lambda t: (owner[t], t))
    new = [i == 0 or owner[t] < 0 or owner[t] != owner[listed[i - 1]] for i, t in enumerate(listed)]
    return listed, np.cumsum(new) - 1


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query with a score above 0, equal scores by doc_id.

    ``docs`` has doc_id and text, ``queries`` item_id and text. Queries are searched in blocks of ``block_terms`` terms,
    one scan of the documents a block. NULL or empty text has no terms: such a query has no result, such a document is in none. NULL doc_id:
    ranked behind equal scores with an id. Repeated rows are documents, or queries, of their own; each query has its own ranks.
    Without documents or queries the result is empty.
    """
    key = F.monotonically_increasing_id().alias("item")
    asked = materialise(queries.select("item_id", terms("text").alias("terms")).where(F.size("terms") > 0).select(key, "item_id", "terms", F.size("terms").alias("n_terms")), "queries")
    items, blocks = _blocked(asked, block_terms)
    kind = docs.schema["doc_id"].dataType
    found = None
    for block in range(blocks):
        mine = items.where(F.col("block") == block).select("item", "terms").collect()  # bounded by block_terms
        if not mine:
            continue
        vocabulary, group = _vocabulary([[bytes(t) for t in r.terms] for r in mine])
        places = {t: i for i, t in enumerate(vocabulary)}
        rows = docs.select("doc_id", term_counts("text", vocabulary).alias("c")).select("doc_id", "c.*").where("n > 0")
        counted = materialise(rows, "vectors")
        about = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        df = dict(counted.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # a row a term of the block
        weights = np.array([weight_of(df[i], about.docs) if i in df else 0 for i in range(len(vocabulary))], np.int64)
        vectors = [np.unique(np.array([places[bytes(t)] for t in r.terms]), return_counts=True) for r in mine]
        part = Queries([r.item for r in mine], vectors, weights, group, about.docs, about.terms or 0, top)
        out = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
        arrow = pa.schema([("item", pa.int64()), ("doc_id", _arrow_type(kind)), ("score", pa.int64())])
        best = counted.where(F.size("term") > 0).mapInArrow(_search(part, arrow), out)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
