"""Rows of one large JSON document, read by many tasks.

The document is cut at closing braces by Spark's own splittable text reader, so a piece is what
stands between two of them, wherever its byte range begins. What a range of pieces does to the
state of a JSON parser (inside a string or not, how deep in brackets) depends only on the state it is
entered in: it flips the string state by the parity of its quotes and changes the depth by one of
two amounts. So each range is summed up once for both cases, the sums (a row per byte range of some
hundred megabytes) are composed in order by the driver, and then every piece knows its own state. Pieces
between two ends of a row make a row's text.

A document may stand in several files, its parts, which many tasks can write; the states are then composed across them.

Rows are objects in the document's array, or in an array that is a member of the document's
object. Only text at the depth of members is looked at token by token.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A byte range: rows of it stand in one task, in order.
RANGE = ["file", "block"]
END = "}"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (order within the block), size of the file and the text before each closing brace."""
    return spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def _without_escapes(text: Column) -> Column:
    """The same length, with no quote that doesn't begin or end a string."""
    return F.regexp_replace(text, r"(?s)\\.", "__")


def _change(text: Column, closed: Column) -> Column:
    """How much deeper one is after a piece that is entered outside of strings, its closing brace (if ``closed``) included."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"\]")) - closed.cast("int")


def _counted(pieces: DataFrame) -> DataFrame:
    """Pieces with ``flips`` (quotes before, within the block) and their effect: ``odd`` quotes, ``outer`` and ``inner`` change of depth."""
    plain = _without_escapes(F.col("value"))
    upto = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.regexp_count(plain, F.lit('"'))
    rows = pieces.select("*", plain.alias("plain"), quotes.alias("quotes")).withColumn("flips", F.coalesce(F.sum("quotes").over(upto), F.lit(0)))
    even = F.col("quotes") % 2 == 0
    return rows.select(
        "file", "block", "file_size", "at", "value", "quotes", "flips",
        _change(F.col("plain"), even).alias("outer"),
        _change(F.concat(F.lit('"'), F.col("plain")), ~even).alias("inner"),
    )


def _effects(counted: DataFrame) -> DataFrame:
    """What each block does: one row a block, for both states it may be entered in."""
    here = F.col("flips") % 2 == 0  # outside, if the block is entered outside
    return counted.groupBy(*RANGE).agg(
        F.sum("quotes").alias("block_quotes"),
        F.sum(F.when(here, F.col("outer")).otherwise(F.col("inner"))).alias("if_outside"),
        F.sum(F.when(here, F.col("inner")).otherwise(F.col("outer"))).alias("if_inside"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("at").alias("last_at"),
        F.max("file_size").alias("file_size"),
    )


def in_order(name: str) -> tuple[int, str]:
    """Parts are in order of their names; a number in front of one may outgrow its places."""
    return len(name), name


def _entries(spark: SparkSession, effects: DataFrame, whole: str | None) -> DataFrame:
    """The document of each block and its place in it, the state in which it is entered, and which piece no brace closes.

    Composed in order of blocks. A file is a document, or all are parts of the one called ``whole``.
    """
    rows, flips, depth, total = [], 0, 0, 0
    listed = sorted(effects.collect(), key=lambda r: (*in_order(r["file"]), r["block"]))
    for now, following in zip(listed, [*listed[1:], None], strict=True):
        rows.append([now["file"], now["block"], whole or now["file"], len(rows), flips, depth, -1])
        depth += now["if_inside"] if flips % 2 else now["if_outside"]
        flips += now["block_quotes"]
        total += now["bytes"]
        if following is None or following["file"] != now["file"]:
            # The last piece has no brace unless the bytes say so; the reader drops a mark of three bytes at the beginning.
            if (now["file_size"] - total) % 3:
                rows[-1][-1] = now["last_at"]
                depth += flips % 2 == 0  # its effect has a brace that isn't there
            total = 0
            if whole is None:
                flips = depth = 0
    return spark.createDataFrame(rows, "file string, block long, document string, place long, block_flips long, block_depth long, open_at long")


def _placed(pieces: DataFrame, whole: str | None) -> DataFrame:
    """Pieces with their document, the depth after each, whether a string is open then, and whether a brace closes it."""
    counted = _counted(pieces)
    rows = counted.join(_entries(pieces.sparkSession, _effects(counted), whole), RANGE)
    upto = Window.partitionBy(*RANGE).orderBy("at")
    outside = (F.col("block_flips") + F.col("flips")) % 2 == 0
    open_end = F.col("at") == F.col("open_at")
    after_outside = (F.col("block_flips") + F.col("flips") + F.col("quotes")) % 2 == 0
    change = F.when(outside, F.col("outer")).otherwise(F.col("inner")) + (open_end & after_outside).cast("int")
    return rows.withColumn("change", change).select(
        *RANGE, "document", "place", "at", "value",
        (F.col("block_depth") + F.sum("change").over(upto)).alias("depth"),
        (~after_outside).alias("in_string"), (~open_end).alias("braced"),
    )


def _elements(placed: DataFrame, base: int) -> DataFrame:
    """file, element (number), text, is_row, depth, in_string: texts from the end of a row at depth ``base`` to the end of the next.

    What follows the last row has is_row false; its depth says whether the document is complete.
    """
    ends = F.col("braced") & ~F.col("in_string") & (F.col("depth") == base)
    rows = placed.withColumn("ends", ends.cast("int"))
    blocks, before = [], Counter()
    for r in sorted(rows.groupBy(*RANGE, "document", "place").agg(F.sum("ends").alias("n")).collect(), key=lambda r: r["place"]):
        blocks.append((r["file"], r["block"], before[r["document"]]))
        before[r["document"]] += r["n"]
    known = placed.sparkSession.createDataFrame(blocks, "file string, block long, block_element long")
    upto = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("element", F.coalesce(F.sum("ends").over(upto), F.lit(0))).join(known, RANGE)
    said = F.concat("value", F.when(F.col("braced"), END).otherwise(""))
    part = F.struct("place", "at", said.alias("said"), "ends", "depth", "in_string")
    grouped = numbered.groupBy(F.col("document").alias("file"), (F.col("block_element") + F.col("element")).alias("element")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    last = F.element_at("parts", -1)
    return grouped.select(
        "file", "element", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"),
        (last["ends"] == 1).alias("is_row"), last["depth"].alias("depth"), last["in_string"].alias("in_string"),
    )


def _members(elements: DataFrame) -> DataFrame:
    """file, element, name, is_array and start (in the element's text, of what follows the bracket) of the document's members.

    Most elements follow a row of the same array directly; the others are looked at token by token.
    """
    odd = elements.where((F.col("element") == 0) | ~F.col("text").rlike(r"^\s*,\s*\{"))
    tokens = F.regexp_extract_all(_without_escapes(F.col("text")), F.lit('("[^"]*"|[^"])'), F.lit(1))
    listed = odd.select("file", "element", "text", F.posexplode(tokens).alias("n", "token"))
    upto = Window.partitionBy("file", "element").orderBy("n")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("token").isin("[", "{"), 1).when(F.col("token").isin("]", "}"), -1).otherwise(0)
    entered = F.when(F.col("element") == 0, 0).otherwise(2)
    told = listed.select(
        "*",
        (entered + F.coalesce(F.sum(step).over(before), F.lit(0))).alias("depth"),
        (1 + F.coalesce(F.sum(F.length("token")).over(before), F.lit(0))).alias("start"),
    ).where(~F.col("token").rlike(r"^\s$"))
    told = told.select("*", F.lead("token").over(upto).alias("colon"), F.lead("token", 2).over(upto).alias("value"), F.lead("start", 2).over(upto).alias("at"))
    raw = F.substr("text", F.col("start").cast("int"), F.length("token"))
    return told.where((F.col("depth") == 1) & (F.col("colon") == ":") & F.col("token").startswith('"')).select(
        "file", "element", F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]").alias("name"),
        (F.col("value") == "[").alias("is_array"), (F.col("at") + 1).cast("int").alias("start"),
    )


def row_texts(spark: SparkSession, path: str, dataset: str, wrapped: bool, parts: bool = False) -> DataFrame | None:
    """A column ``value`` with the text of each row, in no order; None if the array holds no object.

    ``wrapped``: the rows stand in a member of the document's object, the one called as the dataset, or the only one. The
    document is plain JSON in UTF-8 with strings in double quotes. If ``path`` is a folder each of its files is a document;
    with ``parts`` they are one document, in order of their names, cut at ends of lines.
    Anything that isn't an object among the rows is an error, and so is a document that ends too early.
    """
    elements = _elements(_placed(_pieces(spark, path), path if parts else None), 2 if wrapped else 1)
    text = F.col("text")
    if not wrapped:
        following, first, end = r"^\s*,\s*(?=\{)", r"^\uFEFF?\s*\[\s*(?=\{)", r"^(\uFEFF?\s*\[)?\s*\]\s*$"
        right = F.when(~F.col("is_row"), text.rlike(end)).when(F.col("element") == 0, text.rlike(first)).otherwise(text.rlike(following))
        rows = elements.where("is_row").select(F.regexp_replace("text", f"{first}|{following}", "").alias("value"))
        return _told(elements, F.col("is_row"), ~right, rows, dataset)
    members = _members(elements)
    named = (F.col("name") == dataset) & F.col("is_array")
    kind = F.struct("name", "is_array")
    seen = members.agg(F.count_if(named).alias("named"), F.min(kind).alias("least"), F.max(kind).alias("most")).first()
    if seen["named"]:
        name = dataset
    elif seen["least"] is not None and seen["least"] == seen["most"] and seen["least"]["is_array"]:
        name = seen["least"]["name"]
    else:
        raise ValueError(f"no member of the JSON of '{dataset}' can be taken for its rows")
    # Elements from the one in which the array opens to the one in which the next member begins.
    order = Window.partitionBy("file").orderBy("element", "start")
    spans = members.select("*", F.lead("element").over(order).alias("stop")).where((F.col("name") == name) & F.col("is_array"))
    spans = spans.select(F.col("file").alias("of"), F.col("element").alias("opens"), "start", "stop").collect()  # one row per document
    spans = spark.createDataFrame(spans, "of string, opens long, start int, stop long")
    inside = (F.col("element") >= F.col("opens")) & (F.col("stop").isNull() | (F.col("element") < F.col("stop")))
    own = F.when(F.col("element") == F.col("opens"), F.expr("substr(text, start)")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    own = F.when(F.col("is_row") & inside, F.regexp_replace(own, r"^\s+", ""))
    found = elements.join(spans, F.col("file") == F.col("of"), "left").select("file", "element", "is_row", "depth", "in_string", own.alias("value"))
    wrong = F.coalesce(~F.col("value").startswith("{"), F.lit(False))
    return _told(found, F.col("value").isNotNull(), wrong, found.where("value IS NOT NULL").select("value"), dataset)


def _told(elements: DataFrame, row: Column, wrong: Column, rows: DataFrame, dataset: str) -> DataFrame | None:
    """The rows, once the elements are known to be a whole document without other things among them."""
    last = F.max(F.struct("element", "is_row", "depth", "in_string")).alias("last")
    told = elements.groupBy("file").agg(last, F.count_if(row).alias("rows"), F.count_if(wrong).alias("wrong"))
    cut = (F.col("last.depth") != 0) | F.col("last.in_string")
    about = told.agg(F.sum("rows").alias("rows"), F.sum("wrong").alias("wrong"), F.count_if(cut).alias("cut")).first()
    if about["cut"]:
        raise ValueError(f"the JSON of '{dataset}' is not complete")
    if about["wrong"]:
        raise ValueError(f"the JSON of '{dataset}' holds something else than objects among its rows")
    return rows if about["rows"] else None
