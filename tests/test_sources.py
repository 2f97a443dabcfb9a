"""Landing, JSON documents, extraction, JDBC options."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgermatch.plans import Catalog
from ledgermatch.qa import column_lists
from ledgermatch.recon.spec import CheckSuite
from ledgermatch.recon.suite import run_suite
from ledgermatch.sources.extract import FrameSource, check_sources, extract
from ledgermatch.sources.jdbc import SQLSERVER_RELATION, JdbcSource, PredicateSplit, RangeSplit, depth_bounds
from ledgermatch.sources.landing import Landing, path_exists, read_json_document, write_summary


def put(folder, name, content):
    path = folder / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(content, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "content, expected",
    [
        ([{"b": 1, "a": "é"}, {"a": "x"}], [("é", 1), ("x", None)]),
        ({"d": [{"a": "x", "b": 2}], "n": 1}, [("x", 2)]),
        ({"other": [{"a": "x", "b": 2}]}, [("x", 2)]),
    ],
)
def test_json_documents(spark, tmp_path, content, expected):
    df = read_json_document(spark, put(tmp_path, "d", content), "d")
    assert [tuple(r) for r in df.select("a", "b").collect()] == expected


def test_json_document_after_blanks(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('\n \t[{"a": 1}]', encoding="utf-8")
    assert read_json_document(spark, str(path), "d").collect() == [(1,)]


def test_empty_json_documents(spark, tmp_path):
    for content in ([], {"d": []}):
        df = read_json_document(spark, put(tmp_path, "d", content), "d")
        assert df.columns == [] and df.count() == 0


@pytest.mark.parametrize(
    "content, message",
    [({"x": [1], "y": 2}, "can be taken for its rows"), ({"x": 1}, "can be taken for its rows"), (5, "neither a list nor an object")],
)
def test_json_documents_of_another_shape(spark, tmp_path, content, message):
    with pytest.raises(ValueError, match=message):
        read_json_document(spark, put(tmp_path, "d", content), "d")


def test_missing_inputs(spark, tmp_path):
    put(tmp_path / "src", "a", [])
    put(tmp_path / "src", "b", [])
    put(tmp_path / "trg", "b", [])
    landing = Landing(spark, str(tmp_path))
    assert landing.missing("b") is None
    assert landing.missing("a") == "trg file does not exist"
    assert landing.missing("c") == "src file does not exist; trg file does not exist"
    assert path_exists(spark, str(tmp_path)) and not path_exists(spark, str(tmp_path / "no"))


def test_json_suite_from_files(spark, tmp_path):
    put(tmp_path / "src", "a", [{"id": 1, "STATUS": "x"}, {"id": 2, "STATUS": None}])
    put(tmp_path / "trg", "a", {"a": [{"id": 2, "status": None}, {"id": 1, "status": "x"}]})
    put(tmp_path / "src", "b", [{"id": 1}])
    suite = CheckSuite(lists={"data_list": ["a", "b"]}, mapping_fields={"a": {"STATUS": "status"}})
    result = run_suite(spark, Landing(spark, str(tmp_path)), suite)
    assert [r["status"] for r in result.summary.collect()] == ["PASS", "-ER-"]
    write_summary(result.summary, str(tmp_path / "report"), suite.check_list)
    write_summary(result.summary, str(tmp_path / "report"), suite.check_list)
    report = spark.read.json(str(tmp_path / "report"))
    assert report.count() == 4 and set(report.columns) >= {"check_list", "run_ts", "status"}


@pytest.fixture(scope="module")
def typed(spark):
    return spark.sql(
        "select 1 id, cast(1.50 as decimal(9,2)) price, timestamp_ntz'2024-01-02 03:04:05' ts, '' blank, cast(null as string) nothing"
    )


def test_extract_parquet_and_json(spark, tmp_path, typed):
    sources = {"src": FrameSource({"t": typed}), "trg": FrameSource({"t": typed, "u": typed})}
    log = extract(spark, sources, ["t", "u"], str(tmp_path / "p"))
    rows = {(r["side"], r["dataset"]): (r["rows"], r["error"]) for r in log.collect()}
    assert rows[("src", "t")] == (1, None) and rows[("trg", "u")] == (1, None)
    assert rows[("src", "u")][0] is None and rows[("src", "u")][1]
    back = Landing(spark, str(tmp_path / "p")).load("src", "t")
    assert back.columns == typed.columns and back.first() == typed.first()

    extract(spark, sources, ["t"], str(tmp_path / "j"), fmt="json")
    text = Landing(spark, str(tmp_path / "j")).load("trg", "t").select(typed.columns).first()
    assert tuple(text) == (1, "1.50", "2024-01-02 03:04:05", "", None)
    assert set(Landing(spark, str(tmp_path / "p")).load_all("trg", ["t", "u"])) == {"t", "u"}


def test_extract_refuses_repeated_columns(spark, tmp_path, typed):
    source = FrameSource({"t": typed.select("id", "id")})
    log = extract(spark, {"src": source, "trg": source}, ["t"], str(tmp_path))
    assert all("repeated column names" in r["error"] for r in log.collect())


def test_nothing_is_read_when_a_source_is_unreachable(spark, tmp_path, typed):
    sources = {"src": FrameSource({"t": typed}), "trg": JdbcSource("jdbc:nothing://host/db")}
    probes = {r["side"]: (r["ok"], r["error"]) for r in check_sources(spark, sources).collect()}
    assert probes["src"] == (True, None)
    assert not probes["trg"][0] and "driver" in probes["trg"][1].lower()
    with pytest.raises(ConnectionError, match="trg"):
        extract(spark, sources, ["t"], str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    absent = check_sources(spark, {"src": sources["src"]}).where(~F.col("ok")).first()
    assert absent["error"] == "no connection is configured for this side"


class Recorder:
    """Stands in for the reader of a session and notes what it is asked for."""

    def __init__(self):
        self.read, self.asked = self, {}

    def format(self, name):
        return self.option("format", name)

    def option(self, key, value):
        self.asked[key] = value
        return self

    def options(self, **options):
        self.asked |= options
        return self

    def jdbc(self, url, table, predicates, properties):
        self.asked |= {"url": url, "dbtable": table, "predicates": predicates, **properties}
        return self

    def load(self):
        return self


def test_jdbc_scan_options():
    source = JdbcSource(
        "jdbc:sqlserver://h", {"user": "u"}, SQLSERVER_RELATION,
        {"a": RangeSplit("id", 0, 100, 8), "b": PredicateSplit.by_remainder("id", 3)},
    )
    asked = source.read(Recorder(), "a").asked
    assert asked["dbtable"] == "[dbo].[a]" and asked["format"] == "jdbc" and asked["user"] == "u"
    assert (asked["partitionColumn"], asked["lowerBound"], asked["upperBound"], asked["numPartitions"]) == ("id", "0", "100", "8")
    split = source.read(Recorder(), "b").asked
    assert split["predicates"] == ["(ABS(id % 3) = 0 OR id IS NULL)", "ABS(id % 3) = 1", "ABS(id % 3) = 2"]
    whole = source.read(Recorder(), "c").asked
    assert "numPartitions" not in whole and whole["fetchsize"] == "10000"
    assert JdbcSource("jdbc:mysql://h").read(Recorder(), "t").asked["dbtable"] == "t"
    assert source.query(Recorder(), "SELECT 2").asked["query"] == "SELECT 2"


def test_catalog_sql_and_column_lists(spark):
    feeds = spark.createDataFrame([("f1", "s1", 7), ("f2", "s2", 8)], "feed_code string, source_code string, snapshot_id int")
    registry = spark.createDataFrame([(7, "S:UCDP", "ALL", "Y")], "snapshot_id int, supplier_id string, data_type string, latest string")
    catalog = Catalog({"ucdp_feed_to_sc": feeds, "t_dm_in_data_snapshot": registry})
    query = "SELECT feed_code FROM {ucdp_v_feed_to_sc} WHERE source_code = :code"
    assert catalog.sql(spark, query, {"code": "s1"}).collect() == [("f1",)]
    assert catalog.sql(spark, query, {"code": "s1' OR 'a' = 'a"}).collect() == []
    lists = column_lists(spark, catalog, ["ucdp_v_feed_to_sc", "t_dm_in_data_snapshot"]).collect()
    assert lists[1]["columns_list"] == "feed_code, source_code, snapshot_id"
    assert "nsa_v_feeds" in list(catalog) and len(catalog) == 29


def test_a_new_form_replaces_the_old_one(spark, tmp_path):
    first, second = spark.range(1), spark.range(3)
    for fmt in ("parquet", "json", "parquet"):
        for frame in (first, second):
            sources = {side: FrameSource({"d": frame}) for side in ("src", "trg")}
            log = extract(spark, sources, ["d"], str(tmp_path), fmt=fmt).collect()
            assert {r["rows"] for r in log} == {frame.count()}
            assert Landing(spark, str(tmp_path)).load("src", "d").count() == frame.count()


def test_nan_lands_as_null_in_json(spark, tmp_path):
    frame = spark.sql("SELECT double('NaN') v, array(float('NaN'), 1f) a, named_struct('x', double('NaN'), 'y', 2) s, map('k', double('NaN')) m UNION ALL SELECT 1.5, null, null, null")
    back = Landing(spark, str(tmp_path)).write("src", "d", frame, "json")
    assert dict(back.dtypes)["v"] == "double"
    assert back.where("v is null and a[0] is null and a[1] = 1 and s.x is null and s.y = 2").count() == 1
    assert back.where("v = 1.5 and a is null and s is null").count() == 1


def test_readers_follow_the_manifest(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    assert landing.published("src", "d") is None
    first = landing.publish("src", "d", spark.range(5))
    assert (first.number, first.rows, first.form) == (1, 5, "parquet")
    held = landing.load("src", "d")

    def breaks(_):
        raise RuntimeError("broken on purpose")

    broken = spark.range(9).select(F.udf(breaks, "long")("id").alias("id"))
    with pytest.raises(Exception, match="broken on purpose"):
        landing.publish("src", "d", broken)
    spark.range(7).write.json(landing.path("src", "d", ".jsonl"))
    spark.range(7).write.parquet(landing.path("src", "d"))
    assert landing.load("src", "d").count() == 5 and landing.published("src", "d") == first
    # A reader keeps what it has opened while the next version comes.
    second = landing.publish("src", "d", spark.range(3), "json")
    assert held.count() == 5 and landing.load("src", "d").count() == 3 and second.number == 2
    third = landing.publish("src", "d", spark.range(0))
    assert landing.load("src", "d").count() == 0 and third.rows == 0
    versions = {p.name for p in (tmp_path / "src" / "d.versions").iterdir()}
    assert {second.version, third.version} <= versions and first.version not in versions
    assert landing.missing("d") == "trg file does not exist"


def test_writers_at_the_same_time_publish_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    landing = Landing(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda n: landing.publish("src", "d", spark.range(n)), range(1, 5)))
    last = max(done, key=lambda p: p.number)
    assert sorted(p.number for p in done) == [1, 2, 3, 4] and landing.load("src", "d").count() == last.rows


def test_a_version_that_another_writer_has_removed_is_passed_over(spark, tmp_path, monkeypatch):
    landing = Landing(spark, str(tmp_path))
    for n in range(3):
        landing.publish("src", "d", spark.range(n))
    listed = landing._manifests("src", "d")
    monkeypatch.setattr(landing, "_manifests", lambda side, dataset: [min(listed) - 1, *listed])
    landing._retire("src", "d", max(listed))
    assert landing.load("src", "d").count() == 2


def test_json_versions_keep_columns_and_types(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    frame = spark.sql("select 2 b, 'x' a, cast(null as string) c, named_struct('t', timestamp_ntz'2024-01-02 03:04:05') s, cast(null as int) n")
    back = landing.write("src", "d", frame, "json")
    assert back.columns == ["b", "a", "c", "s", "n"] and back.first() == frame.first()
    with pytest.raises(ValueError, match="csv"):
        landing.publish("src", "d", frame, "csv")


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_ranges(spark):
    split_small(spark, "150")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ["}", '"', "\\", '\\"}', "{[", "],", '"}, {"id": 9', "\n", "é ", ""]
ROWS = [{"id": i, "s": ODD[i % len(ODD)] * (i % 4), "deep": {"}": [{"x": ODD[-i % len(ODD)]}, {}], "[": None}, "list": [[i], []]} for i in range(14)]


@pytest.mark.parametrize("wrap", [
    lambda rows: rows,
    lambda rows: {"d": rows},
    lambda rows: {"only": rows},
    lambda rows: {"about}": {"a": [{"id": 1}], "s": '}\\"'}, "d": rows, "n": 1, "end": {"x": {"y": []}}},
    lambda rows: {"a": [{"id": 5}], "d": rows, "e": [{"id": 7}, {"id": 8}]},
    lambda rows: {"a": [[{"id": 5}], [1]], "e": [], "d": rows},
])
def test_documents_are_read_in_ranges(spark, tmp_path, small_ranges, wrap):
    path, plain = tmp_path / "d.json", tmp_path / "p.json"
    path.write_text(json.dumps(wrap(ROWS), indent=1 if isinstance(wrap(ROWS), list) else None, ensure_ascii=False), encoding="utf-8")
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 8
    plain.write_text(json.dumps(ROWS, ensure_ascii=False), encoding="utf-8")
    back, whole = read_json_document(spark, str(path), "d"), spark.read.option("multiLine", True).json(str(plain))  # the reader of one task
    assert back.schema == whole.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, whole.collect()))


def test_a_marked_document_and_one_with_a_schema(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text("\ufeff" + json.dumps({"x": 1, "d": ROWS}), encoding="utf-8")
    given = read_json_document(spark, str(path), "d", spark.createDataFrame([], "s string, id long").schema)
    assert sorted(map(str, given.collect())) == sorted(str(Row(s=r["s"], id=r["id"])) for r in ROWS)
    path.write_text(json.dumps({"a": [{"x": 1}], "d": [], "b": [{"y": 1}]}), encoding="utf-8")
    assert read_json_document(spark, str(path), "d").columns == []


@pytest.mark.parametrize("text, message", [
    ('[{"a": 1}, {"a": 2', "not complete"), ('[{"a": 1}', "not complete"), ('{"d": [{"a": 1}]', "not complete"), ('[{"a": "x}]', "not complete"),
    ('[{"a": 1}, 5]', "something else"), ('[[{"a": 1}]]', "something else"), ('{"d": [{"a": 1}, 5, {"a": 2}]}', "something else"), ('[null, {"a": 1}]', "something else"),
])
def test_documents_that_are_broken_or_hold_other_rows(spark, tmp_path, small_ranges, text, message):
    path = tmp_path / "d.json"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(ValueError, match=message):
        read_json_document(spark, str(path), "d").collect()


def test_a_repeated_run_replaces_its_summary(spark, tmp_path):
    report = str(tmp_path / "report")
    row = spark.createDataFrame([("a", "PASS"), ("b", "FAIL")], "name string, status string")
    first = write_summary(row, report, "data_list")
    write_summary(row, report, "data_list", "night-1")
    write_summary(row.limit(1), report, "data_list", "night-1")
    assert {(r["run_id"], r["count"]) for r in spark.read.json(report).groupBy("run_id").count().collect()} == {(first, 2), ("night-1", 1)}
    with pytest.raises(ValueError, match="can't name a folder"):
        write_summary(row, report, "data_list", "a/b")


def test_ranges_of_equal_depth(spark):
    """A value of a third of the rows and a long tail: even parts, every row once."""
    skewed = spark.range(30_000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.pow(F.col("id") % 1000, 3)).cast("long").alias("k"),
    )
    bounds = depth_bounds(skewed, "k", 12)
    assert len(bounds) == 12 and bounds == sorted(bounds) and bounds.count(7) >= 3
    for within, most in (("n", 30_000 / 12 * 1.5), (None, 10_100)):
        split = PredicateSplit.by_bounds("k", bounds, within)
        sizes = [skewed.where(p).count() for p in split.predicates]
        assert sum(sizes) == 30_000 and max(sizes) <= most
    # Bounds of other data still read every row once.
    stale = PredicateSplit.by_bounds("k", [5, 5, 900, 10**12])
    assert sum(skewed.where(p).count() for p in stale.predicates) == 30_000
    assert depth_bounds(skewed.where("k is null"), "k", 4) == [] and PredicateSplit.by_bounds("k", []).predicates == ("1 = 1",)


def test_bounds_as_literals(spark):
    days = spark.sql("SELECT DATE'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS d, CAST(id AS DECIMAL(10, 2)) AS x FROM range(100)").selectExpr("CAST(d AS DATE) AS d", "CAST(d AS TIMESTAMP_NTZ) AS t", "x")
    for column in ("d", "t", "x"):
        split = PredicateSplit.by_bounds(column, [r[0] for r in days.where("x % 25 = 0").select(column).orderBy(column).collect()])
        assert [days.where(p).count() for p in split.predicates] == [0, 25, 25, 25, 25]
    texts = spark.createDataFrame([("it's",), ("b",), (None,)], "s string")
    assert [texts.where(p).count() for p in PredicateSplit.by_bounds("s", ["b", "it's"]).predicates] == [1, 1, 1]
    for bad in (True, b"x", "a\\b"):
        with pytest.raises((TypeError, ValueError)):
            PredicateSplit.by_bounds("s", [bad])


def test_the_database_finds_bounds(spark, monkeypatch):
    asked = []

    def query(self, spark, sql):
        asked.append(sql)
        return spark.createDataFrame([(2, 7), (1, 1), (3, 7)], "tile int, bound int")

    monkeypatch.setattr(JdbcSource, "query", query)
    split = JdbcSource("jdbc:mysql://h").depth_split(spark, "t", "k", 3)
    assert "NTILE(3) OVER (ORDER BY k)" in asked[0] and "FROM t WHERE k IS NOT NULL" in asked[0]
    assert split.predicates == ("(k < 1 OR k IS NULL)", "k >= 1 AND k < 7", "k = 7", "k > 7")


CUT = [
    '{"about": {"n": [1,\n', ' {"}": "]"}]},\n', '"d": [{"id": 0, "s": "a}\\\\"},\n', '{"id": 1,\n', '"s": "é{\\""\n', '}\n', ", \n", '{"id": 2, "s": null}, {"id": 3, "s": "x"}', ', {"id": 4, "s": "\\"}"}', '], "rest":\n', ' [{"id": 9}]}\n',
]


def put_parts(folder, parts, name="part-{:05d}-c000.txt"):
    path = folder / "src" / "d.json.parts"
    path.mkdir(parents=True)
    for i, text in enumerate(parts):
        (path / name.format(99995 + i)).write_text(text, encoding="utf-8")
    (path / "_SUCCESS").write_text("")
    return str(path)


@pytest.mark.parametrize("wrap", [True, False])
def test_a_document_in_parts_is_one_document(spark, tmp_path, small_ranges, wrap):
    parts = CUT if wrap else ["\n", "[\n", CUT[2][6:], *CUT[3:9], "\n]", "\n"]
    given = json.loads("".join(parts))
    path = put_parts(tmp_path, parts)
    back = Landing(spark, str(tmp_path), {"d": spark.createDataFrame([], "id long, s string").schema}).load("src", "d")
    assert sorted(map(tuple, back.collect())) == [(r["id"], r["s"]) for r in (given["d"] if wrap else given)]
    assert read_json_document(spark, path, "d", parts=True).columns == ["id", "s"]


@pytest.mark.parametrize("lost, message", [(-1, "not complete"), (1, "can be taken"), (2, "not complete|something else|can be taken")])
def test_a_document_that_lacks_a_part(spark, tmp_path, lost, message):
    parts = [part for i, part in enumerate(CUT) if i != lost % len(CUT)]
    path = put_parts(tmp_path, parts)
    with pytest.raises(ValueError, match=message):
        read_json_document(spark, path, "d", parts=True).collect()


def test_no_task_writes_a_whole_document(spark, tmp_path, monkeypatch):
    from ledgermatch.workload import estate

    docs = spark.range(400).selectExpr("id doc_id", "'src' source", "repeat(concat('}\\\\n\"', id), 400) text")
    monkeypatch.setattr(estate, "_shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(estate, "relations", lambda spark, sf_dir: {"documents": docs})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        back = estate.json_document_split(spark, "")
        expected = docs.selectExpr("doc_id", "source", "md5(encode(text, 'UTF-8')) digest")
        assert back.exceptAll(expected).isEmpty() and back.count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "src").glob("documents.json*/part-*"))
    sizes = [f.stat().st_size for f in files]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2
    assert [r["doc_id"] for r in json.loads("".join(f.read_text(encoding="utf-8") for f in files))["documents"]] == list(range(400))
