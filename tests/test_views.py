"""Derived datasets on random small relations full of NULLs, repeats and gaps.

The expected result is the same SQL as for the large check, run by DuckDB.
"""

from __future__ import annotations

import random

import duckdb
import pytest
from oracle import differences

from ledgermatch.plans import DATASETS, Catalog
from ledgermatch.workload.derived import ORACLE

SNAPSHOTS = (
    "snapshot_id int, supplier_id string, data_type string, latest string",
    [(1946, "S:UCDP", "ALL", "N"), (1947, "S:UCDP", "ALL", "Y"), (2001, "S:NR", "ALL", "Y"), (2101, "S:RDS", "RDS_PRODUCTS", "Y"),
     (2201, "S:PS2", "PE_PDP", "Y"), (2202, "S:PS2", "PE_PLI", "Y"), (2301, "S:UCDP", "MRN", "Y")],
)

NP, NS, BARE = ["NP:a", "NP:b", "c", "NP:NP:d", None], ["NS:a", "NS:b", "c", None], ["a", "b", "c", "NS:d", None]
COLLECTION, TEXT, FLAG = ["HV", "NW", "XX", None], ["x", "y", "", None], ["Y", "N"]
CONS, FEED, NUM = [653, 654], ["f1", "f2", "f3", None], ["1", "22M", "M", "", "N/A", None]

#: relation -> column -> type and possible values
RELATIONS = {
    "t_dm_consolidation": {"consolidation_id": ("int", CONS), "latest": ("string", FLAG), "status": ("string", ["COMPLETED", "OPEN"])},
    "t_content_collection": {"content_collection_id": ("string", COLLECTION), "content_collection": ("string", TEXT)},
    "t_all_product_code": {"product_code": ("string", NP), "mnemonic": ("string", BARE), "name": ("string", TEXT), "content_collection_id": ("string", COLLECTION), "supplier_id": ("string", TEXT), "consolidation_id": ("int", CONS)},
    "t_all_source_code": {"source_code": ("string", NS), "mnemonic": ("string", BARE), "name": ("string", TEXT), "descr": ("string", TEXT), "status": ("string", TEXT), "availability": ("string", TEXT), "content_collection_id": ("string", COLLECTION), "supplier_id": ("string", TEXT), "publisher": ("string", TEXT), "url": ("string", TEXT), "consolidation_id": ("int", CONS)},
    "t_ref_data_relations": {"code": ("string", NP + NS), "code_type": ("string", ["NP", "NS", None]), "ref_type": ("string", ["COUNTRY", "REGION", "PUBLICATION", "LANGUAGE", "INDUSTRY"]), "ref_id": ("int", [1, 2, None]), "consolidation_id": ("int", CONS)},
    **{t: {"id": ("int", [1, 2, None]), c: ("string", TEXT), "consolidation_id": ("int", CONS)} for t, c in (("t_ref_country", "country"), ("t_ref_region", "region"), ("t_ref_publication_type", "publication_type"), ("t_ref_language", "language"), ("t_ref_industry", "industry"))},
    "t_feed_product_code": {"feed_code": ("string", FEED), "product_code": ("string", NP), "consolidation_id": ("int", CONS)},
    "t_feed_source_code": {"feed_code": ("string", FEED), "source_code": ("string", NS), "sc_content_collection_id": ("string", COLLECTION), "consolidation_id": ("int", CONS)},
    "t_feed_pe_code": {"feed_code": ("string", FEED), "pe_code": ("string", ["1", "10", "9", None]), "consolidation_id": ("int", CONS)},
    "t_feed_codes": {"feed_code": ("string", FEED), "code": ("string", NS), "consolidation_id": ("int", CONS)},
    "t_feeds": {"feed_code": ("string", FEED), **{c: ("string", TEXT) for c in ("description", "parser", "parser_descr", "onboarder", "onboarder_descr", "copyrightOwner")}, "feed_instance_count": ("int", [1, 2]), "consolidation_id": ("int", CONS)},
    "t_mapped_source_code": {"source_code": ("string", NS), "mnemonic": ("string", BARE), "name": ("string", TEXT), "content_collection_id": ("string", COLLECTION), "consolidation_id": ("int", CONS)},
    "t_product_code_source_code": {"product_code": ("string", NP), "source_code": ("string", NS), "consolidation_id": ("int", CONS)},
    "t_all_sc_journalCode": {"source_code": ("string", BARE), "provider": ("string", TEXT)},
    **{t: {c: ("string", v), "name": ("string", TEXT), "content_collection_id": ("string", COLLECTION), "content_collection": ("string", TEXT), "country": ("string", TEXT), "region": ("string", TEXT), "industry": ("string", TEXT), "consolidation_id": ("int", CONS)} for t, c, v in (("t_all_pc_ref_grouped", "product_code", NP), ("t_all_sc_ref_grouped", "source_code", NS))},
    "bpsa_reference_data": {"source_code": ("string", NS), "code": ("string", TEXT), "value": ("string", [*NUM, "12-3"]), "category": ("string", ["ENTITLEMENT", "NAME"]), "data_type": ("string", ["PECODE", "TRANSLATEDNAME"]), "snapshot_id": ("int", [2000, 2001])},
    "bpsa_source_code": {"source_code": ("string", NS[:3]), "name": ("string", TEXT), "descr": ("string", TEXT), "status": ("string", TEXT), "availability": ("string", TEXT), "contentSet": ("string", ["WEBNEWS", "NEWSROOM", "REFINITIV", "OTHER", None]), "publisher": ("string", TEXT), "url": ("string", TEXT), "snapshot_id": ("int", [2000, 2001])},
    "bpsa_v_product_code_source_code": {"source_code": ("string", NS + BARE), "product_code": ("string", ["RFTHVS", *BARE])},
    "rds_product_code": {"product_code": ("string", NP), "product_name": ("string", TEXT), "source_codes": ("string", TEXT), "not_product_code": ("int", [0, 1, None]), "exclude_from_eikon": ("int", [0, 0, 1]), "snapshot_id": ("int", [2100, 2101])},
    "rds_reference_data": {"code": ("string", NP + NS), "code_type": ("string", ["NP", "NS"]), "data_type": ("string", ["RUN_PE", "LANGUAGE", "IS_NOT_PROD_CODE", "EXCLUDE_FROM_EIKON"]), "value": ("string", ["1", "22M", "M", "N", "false", "true", "en", None]), "snapshot_id": ("int", [2100, 2101])},
    "rds_v_reference_data": {"code": ("string", NP), "code_type": ("string", ["NP", "NS"]), "data_type": ("string", ["RUN_PE", "LANGUAGE"]), "value": ("string", NUM)},
    "rds_v_product_code": {"product_code": ("string", [*NP, "No Product Code"]), "product_name": ("string", TEXT)},
    "rds_v_source_code": {"source_code": ("string", NS[:3]), "source_name": ("string", TEXT)},
    "rcs_v_source_code": {"source_code": ("string", ["NS:a", "a", "q"]), "name": ("string", TEXT), "definition": ("string", TEXT)},
    "rcs_v_product_code": {"product_code": ("string", ["NP:a", "x", "NP:b"]), "name": ("string", TEXT), "definition": ("string", TEXT)},
    "rcs_v_product_code_source_code": {"product_code": ("string", NP), "source_code": ("string", NS)},
    "t_ps2_pdp_pe": {"pe_code": ("string", ["1", "2", "M", None]), "pdp_code": ("string", ["WWEIKON1", "PDP", "PDP 2", None]), "snapshot_id": ("int", [2200, 2201])},
    "t_ps2_pdp": {"pdp_code": ("string", ["WWEIKON1", "PDP", "PDP 2", None]), "pdp_type": ("string", ["Specialist", "General"]), "owner": ("string", ["LUCY CHAPLE", "OTHER", None]), "snapshot_id": ("int", [2200, 2201])},
    "t_ps2_pli": {"product_status": ("string", ["RRG", "XXX"]), "permissioning_key": ("string", ["K WWEIKON1 L", "PDP", "XPDP 2", None]), "snapshot_id": ("int", [2202, 2203])},
    "t_ps2_pe": {"pe_code": ("string", ["1", "2", None]), "pe_name": ("string", TEXT), "snapshot_id": ("int", [2200, 2201])},
    "t_mrn_pe_rules": {"pe_code": ("string", ["1", "2", "3", None]), "snapshot_id": ("int", [2300, 2301])},
    "t_mrn_rule_details": {"pe_code": ("string", ["1", "2", None]), "type": ("string", ["PROVIDER", "LANGUAGE", "URGENCY", "AUDIENCE", "SUBJECT", "INSTANCE", "FULL_LANGUAGE"]), "value": ("string", ["u", "v", None]), "snapshot_id": ("int", [2300, 2301])},
    "nsa_v_mrn_pe_pc": {"product_code": ("string", NP[:4]), "pe_code": ("int", [1, 2, None])},
    "nsa_v_mrn_pe_sc": {"source_code": ("string", NS), "pe_code": ("int", [1, 2, None])},
    **{f"nsa_v_code_{k}": {"code": ("string", NS), k: ("string", TEXT), "consolidation_id": ("int", CONS)} for k in ("country", "industry", "region")},
    **{f"nsa_v_{p}_{k}": {c: ("string", v), f"{k}_id": ("int", [1, 2, None]), "consolidation_id": ("int", CONS)} for p, c, v in (("pc", "product_code", NP), ("sc", "source_code", NS)) for k in ("country", "industry", "region")},
    "ucdp_v_feed": {"feed_code": ("string", FEED[:3]), "feed_index": ("int", None), **{c: ("string", TEXT) for c in ("isnative", "isinternal", "feedid", "visibility", "state", "copyrightOwner", "description", "parser", "parser_descr", "onboarder", "onboarder_descr")}, "snapshot_id": ("int", [1946, 1947])},
    "ucdp_feed_to_sc": {"feed_code": ("string", ["f1", "f2", "f4"]), "source_code": ("string", ["a", "b", "zz"]), "snapshot_id": ("int", [1946, 1947])},
}

_DUCK = {"int": "INTEGER", "string": "VARCHAR"}


def random_relations(spark, seed):
    rng = random.Random(seed)
    con, frames = duckdb.connect(), {}

    def put(name, columns, rows):
        frames[name] = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in columns)).coalesce(1)
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{chr(34)}{c}{chr(34)} {_DUCK[t]}' for c, t in columns)})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)

    for name, columns in RELATIONS.items():
        n = rng.randint(3, 14)
        rows = [
            tuple(i if values is None else rng.choice(values) for _, values in columns.values()) for i in range(n)
        ]
        put(name, [(c, t) for c, (t, _) in columns.items()], rows + rows[: rng.randint(0, 2)] * (name != "ucdp_v_feed"))
    schema, rows = SNAPSHOTS
    put("t_dm_in_data_snapshot", [tuple(c.split(" ")) for c in schema.split(", ")], rows)
    return frames, con


@pytest.mark.parametrize("seed", [0, 2])
def test_all_datasets(spark, seed):
    frames, con = random_relations(spark, seed)
    catalog = Catalog(frames)
    found = {name: differences(catalog[name], con, ORACLE[name]) for name in DATASETS}
    assert {k: v for k, v in found.items() if v} == {}
