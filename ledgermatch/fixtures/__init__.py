"""Test data: the input relations of the derived datasets, made from the test tables.

``relations.sql`` holds one ``name := query`` per line in dependency order. The
same text runs on Spark and on the DuckDB oracle; only ``each(...)``, one output
row per listed value, is spelled differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.operators.pairing import linked, linked_and

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _load() -> dict[str, str]:
    lines = (Path(__file__).parent / "relations.sql").read_text(encoding="utf-8").splitlines()
    pairs = (line.split(" := ", 1) for line in lines if " := " in line and not line.startswith("--"))
    return {name.strip(): query.strip() for name, query in pairs}


RELATIONS = _load()


def _mentions(query: str, names: Mapping[str, object] | tuple[str, ...]) -> list[str]:
    words = set(re.findall(r"\w+", query))
    return [n for n in names if n in words]


def needed(names: list[str]) -> list[str]:
    """The relations that ``names`` rest on, including themselves, in order."""
    found: set[str] = set()
    todo = [n for n in names if n in RELATIONS]
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += _mentions(RELATIONS[name], RELATIONS)
    return [n for n in RELATIONS if n in found]


def _feed_products(rel: Mapping[str, DataFrame]) -> DataFrame:
    products = rel["t_product_code_source_code"].select("product_code", "source_code", "consolidation_id")
    feeds = rel["t_feed_source_code"].select("feed_code", "source_code", "consolidation_id")
    # Dealt by feed: the products of a source make longer lists than its feeds.
    found = linked(products, "product_code", feeds, "feed_code", ["source_code", "consolidation_id"], ["consolidation_id"])
    return found.select("feed_code", "product_code", "consolidation_id")


def _feed_codes(rel: Mapping[str, DataFrame]) -> DataFrame:
    sources = rel["t_feed_source_code"].select("feed_code", "source_code", "consolidation_id")
    products = rel["t_product_code_source_code"].select(F.col("product_code").alias("code"), "source_code", "consolidation_id")
    own = sources.withColumnRenamed("source_code", "code")
    found = linked_and(own, sources, "feed_code", products, "code", ["source_code", "consolidation_id"], ["consolidation_id"])
    return found.select("feed_code", "code", "consolidation_id")


def _ordered(rel: Mapping[str, DataFrame]) -> DataFrame:
    """Line items with the customer of their order; the orders are hashed, so that no task sorts its line items."""
    orders = rel["orders"].select("o_orderkey", "o_custkey").hint("shuffle_hash")
    return rel["lineitem"].select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _bpsa_pairs(rel: Mapping[str, DataFrame]) -> DataFrame:
    bought = _ordered(rel).selectExpr("'S'||cast(o_custkey as string) source_code", "'P'||cast(l_partkey as string) product_code")
    source = "case when c_custkey%2=0 then 'NS:S' else 'S' end||cast(c_custkey as string) source_code"
    return bought.union(rel["customer"].where("c_custkey%7=0").selectExpr(source, "'RFTHVS' product_code"))


def _rcs_pairs(rel: Mapping[str, DataFrame]) -> DataFrame:
    source = "case when l_orderkey%2=0 then 'NS:S' else 'S' end||cast(o_custkey as string) source_code"
    return _ordered(rel).selectExpr("'NP:P'||cast(l_partkey as string) product_code", source)


def _sold_pairs(rel: Mapping[str, DataFrame]) -> DataFrame:
    """Numbers are made distinct, before they become codes and before each consolidation repeats them."""
    pairs = _ordered(rel).select("l_partkey", "o_custkey").distinct()
    return pairs.selectExpr("'NP:P'||cast(l_partkey as string) product_code", "'NS:S'||cast(o_custkey as string) source_code", "explode(array(653,654)) consolidation_id")


def _code_references(rel: Mapping[str, DataFrame]) -> DataFrame:
    """As ``_sold_pairs``; the two types of code never share a row."""
    products = rel["lineitem"].where("l_partkey%3<>0").selectExpr("l_partkey key", "l_partkey+l_suppkey%3 a", "l_partkey+l_orderkey%2 b").distinct()
    sources = rel["orders"].where("o_custkey%4<>0").selectExpr("o_custkey key", "o_custkey+o_orderkey%3 a", "o_custkey+o_orderkey%2 b").distinct()
    codes = products.selectExpr("'NP:P'||cast(key as string) code", "'NP' code_type", "a", "b").union(
        sources.selectExpr("'NS:S'||cast(key as string)", "'NS'", "a", "b")
    )
    kinds = codes.selectExpr("*", "explode(array('COUNTRY','REGION','PUBLICATION','LANGUAGE','INDUSTRY')) ref_type")
    ref_id = "case ref_type when 'COUNTRY' then a%25 when 'LANGUAGE' then b%4 else b%5 end ref_id"
    return kinds.selectExpr("code", "code_type", "ref_type", ref_id, "explode(array(653,654)) consolidation_id")


#: Relations that Spark builds with fewer rows between tasks, or fewer held in one; the rows are those of their query.
BUILT: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "t_feed_product_code": _feed_products, "t_feed_codes": _feed_codes,
    "t_product_code_source_code": _sold_pairs, "t_ref_data_relations": _code_references,
    "bpsa_v_product_code_source_code": _bpsa_pairs, "rcs_v_product_code_source_code": _rcs_pairs,
}


def for_spark(query: str) -> str:
    return re.sub(r"\beach\(([^()]*)\)", r"explode(array(\1))", query)


def for_duckdb(query: str) -> str:
    return re.sub(r"\beach\(([^()]*)\)", r"unnest([\1])", query)


def with_clause(query: str) -> str:
    """Put the relations a DuckDB query mentions in front of it."""
    names = needed(_mentions(query, RELATIONS))
    if not names:
        return query
    parts = ",\n".join(f"{n} AS ({for_duckdb(RELATIONS[n])})" for n in names)
    return f"WITH {parts}\nSELECT * FROM (\n{query}\n) AS answer"


class TestRelations(Mapping[str, DataFrame]):
    """Tables of a test folder and the relations derived from them, on demand."""

    __test__ = False  # not a test class

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if name in TABLES:
            frame = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        elif name in BUILT:
            frame = BUILT[name](self)
        else:
            query = RELATIONS[name]
            for other in (*_mentions(query, TABLES), *_mentions(query, RELATIONS)):
                if other != name:
                    self[other].createOrReplaceTempView(other)
            frame = self._spark.sql(for_spark(query))
        self._frames[name] = frame
        return frame

    def __iter__(self) -> Iterator[str]:
        yield from (*TABLES, *RELATIONS)

    def __len__(self) -> int:
        return len(TABLES) + len(RELATIONS)


_OPEN: dict[tuple[int, str, str], TestRelations] = {}


def relations(spark: SparkSession, sf_dir: str) -> TestRelations:
    """The relations of a folder, analysed once per session."""
    # The cached object holds the session, so its id is not given to another one.
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = TestRelations(spark, sf_dir)
    return _OPEN[key]
