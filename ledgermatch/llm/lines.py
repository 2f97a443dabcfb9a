"""Line dedup: windows of three consecutive lines that occur again anywhere.

Lines without a word are passed over and stay. A window that occurred earlier
(in a document with a smaller doc_id, or above in the same one) is a repeat; every
line that a repeat covers is removed, so overlapping repeats merge. Windows are compared by
128 bits of hash, counted with partial sums before the shuffle, and only those that
occur twice are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.shared import materialise, text_key

WINDOW_LINES = 3


def _worded(lines: Column) -> Column:
    """Lines with a word as structs (line, at)."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"[^ \t-\r]"))


def line_windows(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """doc_id, key1, key2, first line, last line, hash1, hash2 of each window of lines."""
    lines = docs.select("doc_id", *text_key(), _worded(F.split("text", "\n", -1)).alias("w")).where(F.size("w") >= width)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("w") - width),
        lambda i: F.struct(
            F.xxhash64(*(F.col("w")[i + k]["line"] for k in range(width))).alias("hash1"),
            F.xxhash64(F.lit(0x2545F491), *(F.col("w")[i + k]["line"] for k in range(width))).alias("hash2"),
            F.col("w")[i]["at"].alias("first"),
            F.array(*(F.col("w")[i + k]["at"] for k in range(width))).alias("covers"),
        ),
    )
    return lines.select("doc_id", "key1", "key2", F.inline(hashed))


def repeated_lines(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """doc_id, key1, key2 (of the text) and ``gone``, the numbers of the lines to remove, for documents that lose any.

    Documents are in order of doc_id, NULL last, then by hash of the text. Rows that
    share doc_id and text are one document: what one of them keeps, all keep.
    """
    every = materialise(line_windows(docs, width), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2", "first")
    firsts = (
        every.groupBy("hash1", "hash2")
        .agg(F.min(order).alias("head"), F.max(order).alias("tail"))
        .where("head <> tail")
        .select("hash1", "hash2", "head")
    )
    # Both sides of the join are plain tables, so a window with very many places can be split among tasks.
    later = every.join(materialise(firsts, "firsts"), ["hash1", "hash2"]).where(order != F.col("head"))
    return later.groupBy("doc_id", "key1", "key2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("gone"))


def deduplicate_lines(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """``row`` (all columns of docs, text without repeated lines), n_lines and n_removed of every document.

    NULL text has no lines and stays NULL; an empty text has one. Lines are compared as they are,
    blanks and carriage returns included. A text of any length is one row.
    """
    wide = docs.select(F.struct("*").alias("row"), "doc_id", "text", *text_key())
    gone = repeated_lines(docs, width).select(F.col("doc_id").alias("of"), F.col("key1").alias("of1"), F.col("key2").alias("of2"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key1") == F.col("of1")) & (F.col("key2") == F.col("of2"))
    split = wide.join(gone, same, "left").select("row", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    return split.select(
        F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)).alias("row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """The documents with repeated lines removed; one that lost lines and has no word left goes."""
    out = deduplicate_lines(docs, width)
    return out.where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"[^ \t-\r]")).select("row.*")
