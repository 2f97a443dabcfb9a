"""The landing area: one folder per side, one dataset per name below it.

What this library lands is versioned:

* ``<dir>/<side>/<name>.versions/<version>``   the rows, Parquet or JSON lines
* ``<dir>/<side>/<name>.manifests/<n>.json``   which version is number n, its form, schema and rows

A version is written to a fresh folder; the manifest appears by one rename once the version is complete. Readers
follow the manifest with the greatest number and nothing else, so a run that breaks at any point leaves the dataset
as it was published before. The version before the last stays for readers that still have it open.

What others put there has one of four forms, read where there is no manifest:

* ``<dir>/<side>/<name>``        Parquet folder; keeps column order and types
* ``<dir>/<side>/<name>.jsonl``  folder of JSON lines; splits across tasks
* ``<dir>/<side>/<name>.json``   one JSON document: an array of rows, or an
  object that wraps the array
* ``<dir>/<side>/<name>.json.parts``  folder with the text of one JSON document in parts: its
  files, one after the other in order of their names, cut at ends of lines
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.functions.canonical import canonical_text, fold_nan_inside
from ledgermatch.recon.diff import column, require_unique_columns
from ledgermatch.sources.json_split import in_order, row_texts

SIDES = ("src", "trg")
#: Held by threads of one session while they number a version.
_NUMBERING = threading.Lock()

_JSON_TYPES = (
    T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.StructType, T.ArrayType, T.MapType, T.VariantType,
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system."""
    where, system = _file_system(spark, path)
    return system.exists(where)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _remove(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    if system.exists(where):
        system.delete(where, True)


def as_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON lines hold them: values without a JSON form (dates, decimals) become text, NaN becomes NULL at any depth."""
    plain = [
        fold_nan_inside(column(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, _JSON_TYPES)
        else canonical_text(column(f.name), f.dataType).alias(f.name)
        for f in df.schema
    ]
    return df.select(*plain)


#: How times inside nested values are written.
_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_JSON_OPTIONS = {"timestampFormat": _TIMES, "timestampNTZFormat": _TIMES}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where, system = _file_system(spark, path)
    out = system.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    where, system = _file_system(spark, path)
    source = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file to a name that isn't taken; False if it is."""
    where, system = _file_system(spark, old)
    aim = spark._jvm.org.apache.hadoop.fs.Path(new)
    if system.exists(aim):
        return False
    if system.rename(where, aim):
        return True
    if system.exists(aim):
        return False
    raise OSError(f"'{old}' can't be renamed to '{new}'")


@dataclass(frozen=True)
class Published:
    """A version of a dataset: its number and folder, its form, its rows and their schema as JSON."""

    number: int
    version: str
    form: str
    rows: int
    schema: str


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The files of a document in parts, in order; without the marks that a writer leaves beside them."""
    where, system = _file_system(spark, path)
    files = [status.getPath() for status in system.listStatus(where) if status.getLen()]
    named = {file.getName(): file.toString() for file in files if not file.getName().startswith(("_", "."))}
    return [named[name] for name in sorted(named, key=in_order)]


def _first_character(spark: SparkSession, path: str) -> str:
    """The first character that is no blank, of what stands before the first closing brace."""
    character = F.regexp_extract("value", r"[^\s\uFEFF]", 0).alias("c")
    found = spark.read.option("lineSep", "}").text(path).limit(1).select(character).collect()
    return found[0]["c"] if found else ""


def read_json_document(
    spark: SparkSession, path: str, dataset: str, schema: T.StructType | None = None, parts: bool = False
) -> DataFrame:
    """Rows of one JSON document; with ``parts`` the files of a folder are its text, in order of their names.

    An array is the rows themselves. An object holds them under the dataset's
    name, or as its only member. Anything else is an error. The document is read in
    byte ranges, by as many tasks as it has. Without ``schema``
    Spark infers the columns and orders them by name.
    """
    files = _parts(spark, path) if parts else [path]
    first = next(filter(None, (_first_character(spark, file) for file in files)), "")
    if first not in ("[", "{"):
        raise ValueError(f"the JSON of '{dataset}' is neither a list nor an object")
    rows = row_texts(spark, path, dataset, wrapped=first == "{", parts=parts)
    if rows is None:
        return _no_rows(spark)  # an empty array has no row type
    reader = spark.read.option("mode", "FAILFAST")
    texts = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame((reader.schema(schema) if schema else reader)._jreader.json(texts), spark)


class Landing:
    """Datasets of both sides below one folder."""

    def __init__(
        self, spark: SparkSession, data_dir: str, schemas: dict[str, T.StructType] | None = None
    ) -> None:
        self._spark = spark
        self._dir = data_dir.rstrip("/")
        self._schemas = schemas or {}

    def path(self, side: str, dataset: str, suffix: str = "") -> str:
        return f"{self._dir}/{side}/{dataset}{suffix}"

    def _found(self, side: str, dataset: str) -> str | None:
        for suffix in ("", ".jsonl", ".json", ".json.parts"):
            if path_exists(self._spark, self.path(side, dataset, suffix)):
                return suffix
        return None

    def _manifests(self, side: str, dataset: str) -> list[int]:
        """Numbers of the published versions, ascending."""
        where, system = _file_system(self._spark, self.path(side, dataset, ".manifests"))
        if not system.exists(where):
            return []
        names = [status.getPath().getName() for status in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _manifest_path(self, side: str, dataset: str, number: int) -> str:
        return f"{self.path(side, dataset, '.manifests')}/{number:012d}.json"

    def published(self, side: str, dataset: str) -> Published | None:
        """The version that readers see; None where this library has landed nothing."""
        numbers = self._manifests(side, dataset)
        if not numbers:
            return None
        text = _read_text(self._spark, self._manifest_path(side, dataset, numbers[-1]))
        return Published(number=numbers[-1], **json.loads(text))

    def publish(self, side: str, dataset: str, df: DataFrame, fmt: str = "parquet") -> Published:
        """Land a dataset as a new version, Parquet or JSON lines ('json'), and say what was published.

        Rows are counted as they are written. Of writers at the same time each publishes its own version; the last to
        finish is the one that is read. Versions before the last but one are removed.
        """
        if fmt not in ("parquet", "json"):
            raise ValueError(f"a dataset is landed as 'parquet' or 'json', not '{fmt}'")
        rows = require_unique_columns(df, self.path(side, dataset))
        rows = as_json_rows(rows) if fmt == "json" else rows
        version, counted = uuid.uuid4().hex, Observation()
        folder = f"{self.path(side, dataset, '.versions')}/{version}"
        writer = rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("error")
        if fmt == "json":
            writer.options(ignoreNullFields="false", **_JSON_OPTIONS).json(folder)
        else:
            writer.parquet(folder)
        about = {"version": version, "form": fmt, "rows": counted.get["rows"], "schema": rows.schema.json()}
        number = self._number(side, dataset, json.dumps(about))
        self._retire(side, dataset, number)
        return Published(number=number, **about)

    def _number(self, side: str, dataset: str, manifest: str) -> int:
        """Put a manifest in place under the next free number, by one rename."""
        folder = self.path(side, dataset, ".manifests")
        draft = f"{folder}/_{uuid.uuid4().hex}"
        _write_text(self._spark, draft, manifest)
        with _NUMBERING:  # not every file system refuses to rename onto a file that has just appeared
            number = max(self._manifests(side, dataset), default=0) + 1
            while not _rename(self._spark, draft, self._manifest_path(side, dataset, number)):
                number += 1
        return number

    def _retire(self, side: str, dataset: str, number: int) -> None:
        """Remove the versions, and their manifests, before the last but one."""
        for old in self._manifests(side, dataset):
            if old < number - 1:
                path = self._manifest_path(side, dataset, old)
                try:
                    version = json.loads(_read_text(self._spark, path))["version"]
                except Py4JJavaError:
                    if path_exists(self._spark, path):
                        raise
                    continue  # a writer at the same time has removed it
                _remove(self._spark, path)  # first, so that no manifest names what is gone
                _remove(self._spark, f"{self.path(side, dataset, '.versions')}/{version}")

    def write(self, side: str, dataset: str, df: DataFrame, fmt: str = "parquet") -> DataFrame:
        """Land a dataset and return it as it reads back."""
        self.publish(side, dataset, df, fmt)
        return self.load(side, dataset)

    def missing(self, dataset: str) -> str | None:
        """Which sides lack the dataset, as a message; None when both have it."""
        absent = [s for s in SIDES if not self._manifests(s, dataset) and self._found(s, dataset) is None]
        return "; ".join(f"{s} file does not exist" for s in absent) or None

    def load(self, side: str, dataset: str) -> DataFrame:
        """The version published last; without one what others have put there."""
        schema = self._schemas.get(dataset)
        now = self.published(side, dataset)
        if now is not None:
            reader = self._spark.read.schema(schema or T.StructType.fromJson(json.loads(now.schema)))
            folder = f"{self.path(side, dataset, '.versions')}/{now.version}"
            return reader.options(**_JSON_OPTIONS).json(folder) if now.form == "json" else reader.parquet(folder)
        suffix = self._found(side, dataset)
        path = self.path(side, dataset, suffix or "")
        if suffix in (".json", ".json.parts"):
            return read_json_document(self._spark, path, dataset, schema, parts=suffix == ".json.parts")
        reader = self._spark.read if schema is None else self._spark.read.schema(schema)
        return reader.json(path) if suffix == ".jsonl" else reader.parquet(path)

    def load_all(self, side: str, datasets: list[str]) -> dict[str, DataFrame]:
        return {name: self.load(side, name) for name in datasets}


def write_summary(summary: DataFrame, report_dir: str, check_list: str, run_id: str | None = None) -> str:
    """Add a run's summary rows, stamped with the time, the list's name and the run; returns the run's id.

    Each run has a partition of its own (``run_id=...``), so the report reads as one table. A run that is repeated under its
    id replaces its rows; without an id every call is a run of its own.
    """
    run_id = run_id or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"'{run_id}' can't name a folder: letters, digits and _ . - only")
    (
        summary.withColumn("check_list", F.lit(check_list))
        .withColumn("run_ts", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
        .write.mode("overwrite")
        .json(f"{report_dir}/run_id={run_id}")
    )
    return run_id
