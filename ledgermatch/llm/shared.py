"""What the operators of this subpackage share: tables, folders for intermediate tables, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders chosen here, by application, where the session names none.
_OWN: dict[str, str] = {}
#: Paths handed out within ``scratch``.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgermatch-llm-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; within ``scratch`` it is removed at the end."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of ``fresh_path`` with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the operators called inside are removed at the end, also after an error.

    DataFrames of these operators read such tables, so what is wanted of them must be written inside,
    to a path that was taken before.
    """
    paths: list[str] = []
    before = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage at files that outlive a lost executor, and gives the
    optimizer the true size of the table for what follows.
    """
    return written(df, fresh_path(df.sparkSession, name))


def text_key(text: Column | str = "text") -> list[Column]:
    """Two longs that name a text (128 bits of hash; NULL is another text than '')."""
    text = F.col(text) if isinstance(text, str) else text
    blank = F.coalesce(text, F.lit(""))
    return [
        F.xxhash64(blank, text.isNull()).alias("key1"),
        F.xxhash64(F.lit(0x5BD1E995), blank, text.isNull()).alias("key2"),
    ]


def rows_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside ``row``, a struct of all columns.

    Operators that hand whole rows on work on this form, so that no column of
    the caller can clash with their own.
    """
    return df.select(F.struct("*").alias("row"), *(F.col(c) for c in columns))
