"""The derived datasets, by name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.plans import entitlements, feeds, news_map, product_codes, source_codes

Relations = Mapping[str, DataFrame]

#: Names are part of the interface: users ask for a dataset by name.
DATASETS: dict[str, Callable[[Relations], DataFrame]] = {
    "nsa_v_all_pc_ref_grouped": product_codes.all_pc_ref_grouped,
    "nsa_v_all_sc_ref_grouped_1": source_codes.all_sc_ref_grouped_1,
    "nsa_v_all_sc_ref_grouped_2": source_codes.all_sc_ref_grouped_2,
    "nsa_v_all_sc_ref_grouped": source_codes.all_sc_ref_grouped,
    "nsa_v_all_sc_pc_ref_grouped": product_codes.all_sc_pc_ref_grouped,
    "nsa_v_news_map": news_map.news_map,
    "nsa_v_feeds": feeds.feeds,
    "nsa_v_news_map_variant": news_map.news_map_variant,
    "nsa_v_feed_content_collection": feeds.feed_content_collection,
    "nsa_v_feed_country": feeds.feed_country,
    "nsa_v_feed_industry": feeds.feed_industry,
    "nsa_v_feed_region": feeds.feed_region,
    "nsa_v_feed_source_code": feeds.feed_source_code,
    "nsa_v_feed_to_codes": feeds.feed_to_codes,
    "nsa_v_not_covered_feeds": feeds.not_covered_feeds,
    "ucdp_v_feed_to_sc": feeds.feed_to_source_code,
    "nsa_v_mapped_source_code": source_codes.mapped_source_code,
    "rds_v_all_pc_pe": entitlements.all_product_permissions,
    "rds_v_pc_pe": entitlements.product_permissions,
    "tmp_nsa_v_feed_all_grouped": feeds.feed_all_grouped,
    "bpsa_v_source_code_pe_code": entitlements.source_permissions,
    "nsa_v_all_source_codes": source_codes.all_source_codes,
    "nsa_v_mrn_pe_search": entitlements.permission_search,
    "nsa_v_all_pc_to_pe": entitlements.product_to_permission,
    "nsa_v_all_product_code_source_code": product_codes.product_code_source_code,
    "nsa_v_all_product_codes": product_codes.all_product_codes,
    "view_product_source_codes": product_codes.product_source_codes,
}


class Catalog(Mapping[str, DataFrame]):
    """Relations by name: derived datasets are built on demand, others are inputs.

    ``inputs`` is any mapping of name to DataFrame, for instance landed tables.
    Frames are lazy, so asking for a name only extends the plan.
    """

    def __init__(self, inputs: Relations) -> None:
        self._inputs = inputs
        self._built: dict[str, DataFrame] = {}
        self._asked: dict[str, set[str]] = {}
        self._building: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        if self._building:
            self._asked[self._building[-1]].add(name)
        if name in self._built:
            return self._built[name]
        if name not in DATASETS:
            return self._inputs[name]
        self._asked[name] = set()
        self._building.append(name)
        try:
            self._built[name] = DATASETS[name](self)
        finally:
            self._building.pop()
        return self._built[name]

    def rests_on(self, names: Iterable[str]) -> dict[str, set[str]]:
        """The relations that each of ``names``, and each derived dataset below them, asks for; in order of dependency."""
        graph: dict[str, set[str]] = {}

        def visit(name: str) -> None:
            if name in DATASETS and name not in graph:
                _ = self[name]
                for other in sorted(self._asked[name]):
                    visit(other)
                graph[name] = self._asked[name]

        for name in names:
            visit(name)
        return graph

    def materialised(self, folder: str, names: Iterable[str], inputs: bool = False, parallelism: int = 4) -> Catalog:
        """A catalog in which everything that several of ``names`` rest on has been written below ``folder`` once.

        Shared datasets are those that are asked for twice or more, being one of ``names`` counting as well. They are written as
        Parquet in order of dependency, a few at a time, each from what is written already; the rest stays lazy.
        Inputs are read where they are, unless ``inputs`` says that they are costly too.
        """
        names = list(names)
        graph = self.rests_on(names)
        asked = Counter(other for others in graph.values() for other in others) + Counter(dict.fromkeys(names, 1))
        out = Catalog(self._inputs)

        def write(name: str) -> None:
            frame = out[name]
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")
            written[name] = frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

        shared = [n for n in graph if asked[n] > 1]
        waves = [[n for n in asked if n not in DATASETS and asked[n] > 1]] if inputs else []
        depth: dict[str, int] = {}
        for name in graph:  # below before above
            depth[name] = max((depth[o] + (o in shared) for o in graph[name] if o in depth), default=0)
        waves += [[n for n in shared if depth[n] == level] for level in range(max(depth.values(), default=-1) + 1)]
        done: dict[str, DataFrame] = {}
        for wave in filter(None, waves):
            written: dict[str, DataFrame] = {}
            for name in wave:
                _ = out[name]  # plans are built here, in one thread
            with ThreadPoolExecutor(parallelism) as pool:
                list(pool.map(write, wave))
            done |= written
            out = Catalog(self._inputs)
            out._built |= done
        return out

    def __iter__(self):
        yield from dict.fromkeys([*self._inputs, *DATASETS])

    def __len__(self) -> int:
        return len(set(self._inputs) | set(DATASETS))

    def sql(self, spark: SparkSession, query: str, args: dict[str, Any] | None = None) -> DataFrame:
        """Run a read query; relations are written ``{name}``, parameters ``:name``.

        Parameters are bound as literals, never pasted into the text.
        """
        names = {field for _, field, _, _ in Formatter().parse(query) if field}
        return spark.sql(query, args=args, **{name: self[name] for name in names})

    def register(self) -> None:
        """Offer the derived datasets to SQL as temporary views."""
        for name in DATASETS:
            self[name].createOrReplaceTempView(name)
