import datetime as dt
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from marketlake.operators import ingest
from marketlake.sources import files, versions, warehouse
from marketlake.sources.http import HttpDocuments
from tests.test_operators import BARS, day, panel


@pytest.fixture(scope="module")
def server():
    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/")
            seen[name] = seen.get(name, 0) + 1
            code = 404 if name == "gone" else 503 if name == "down" or (name == "flaky" and seen[name] < 3) else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1.5,10\r\nbad\n" if code == 200 else b"")

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{key}}"
    s.shutdown()


def test_http_documents(spark, server):
    spark.dataSource.register(HttpDocuments)
    read = spark.read.format("http_documents").option("template", server).option("keys", "a,flaky,gone,down").option("batch", "2").option("backoff", "0.01").load()
    got = {r["key"]: r for r in read.collect()}
    assert got["a"]["status"] == got["flaky"]["status"] == 200
    assert got["gone"]["status"] == 404 and got["gone"]["body"] is None and got["gone"]["error"] is None
    assert got["down"]["status"] is None and got["down"]["error"] == "HTTP 503"
    bars = ingest.csv_bars(read.where("key = 'a' or key = 'gone'"))
    assert [tuple(r) for r in bars.collect()] == [("a", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0)]


def test_refresh_takes_each_ticker_from_one_source(spark, tmp_path):
    whole, hole = [10.0 + i for i in range(6)], [10.0, None, None, None, None, None]
    good = panel(spark, whole)
    broken = lambda t: spark.createDataFrame([(t, day(i), c, None if c is None else c + 1, None if c is None else c - 1, c, 5.0) for i, c in enumerate(hole)], BARS)
    landed = good
    for t in ("OLD", "RETRY", "FALL", "LOST"):
        landed = landed.unionByName(broken(t))
    renames = spark.createDataFrame([("OLD", "NEW", "active")], "old_ticker string, new_ticker string, status string")
    asked = spark.createDataFrame([(t,) for t in ("A", "OLD", "RETRY", "FALL", "LOST")], "ticker string")
    late = panel(spark, whole + [99.0], "FALL")
    known = spark.createDataFrame([("LONG_GONE",)], "ticker string")
    cached = panel(spark, [1.0, 1.0], "A", volume=7.0).unionByName(panel(spark, whole, "NOT_ASKED"))
    r = ingest.refresh(asked, landed, panel(spark, whole, "NEW"), panel(spark, whole, "RETRY"), renames, str(tmp_path), cached=cached, fallback=late, known_unavailable=known, least=5)
    got = {x["ticker"]: (x["n"], x["v"]) for x in r.panel.groupBy("ticker").agg(F.count("*").alias("n"), F.min("volume").alias("v")).collect()}
    assert got == {"A": (6, 100.0), "OLD": (6, 100.0), "RETRY": (6, 100.0), "FALL": (6, 100.0)}
    assert {x["ticker"] for x in r.unavailable.collect()} == {"LOST", "LONG_GONE"}


def test_short_batches_add_days(spark, tmp_path):
    """Five new days of a ticker with a long cached history are added, however few they are, and it is not given up."""
    long, path = [10.0 + i for i in range(300)], str(tmp_path)
    asked = spark.createDataFrame([("A",), ("B",)], "ticker string")
    renames, none = spark.createDataFrame([], "old_ticker string, new_ticker string, status string"), panel(spark, [1.0]).where("false")
    batch = panel(spark, long + [1.0] * 5).where(F.col("date") >= F.lit(day(299))).unionByName(panel(spark, [2.0] * 5, "B"))
    r = ingest.refresh(asked, batch, none, none, renames, path, cached=panel(spark, long))
    assert {x["ticker"]: x["count"] for x in r.panel.groupBy("ticker").count().collect()} == {"A": 305}
    assert [x["ticker"] for x in r.unavailable.collect()] == ["B"]
    # a later run commits versions of its own; what the first one returned is read as it was
    again = ingest.refresh(asked, none, none, none, renames, path, cached=panel(spark, long[:260]))
    assert again.panel.count() == 260 and r.panel.count() == 305


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.version(spark, path) is None
    one = versions.commit(spark.range(3), path, period="5y")
    reader = one.read(spark)
    two = versions.commit(spark.range(10), path, after=one)
    assert (two.number, reader.count(), versions.version(spark, path).read(spark).count()) == (2, 3, 10)
    assert versions.version(spark, path, 1).facts == {"period": "5y"} and versions.version(spark, path, 9) is None
    with pytest.raises(versions.Conflict):  # made from a version that is not the last any more
        versions.commit(spark.range(1), path, after=one)
    bad = spark.range(1).select(F.raise_error(F.lit("x")).cast("string").alias("id"))
    with pytest.raises(Exception, match="x"):
        versions.commit(bad, path)
    assert versions.version(spark, path).number == 2
    assert versions.clean_up(spark, path, keep=1) == 0  # too young
    assert versions.clean_up(spark, path, keep=1, least_hours=0) >= 2  # the first version and what broke off
    assert versions.version(spark, path, 1) is None and versions.version(spark, path).read(spark).count() == 10


def test_landed_filters_are_pushed(spark, tmp_path):
    panel(spark, [1.0, 2.0]).write.parquet(str(tmp_path / "b"))
    df = ingest.landed_bars(spark, str(tmp_path / "b"), ["A"], after=str(day(0))).select("close")
    assert [r[0] for r in df.collect()] == [2.0]
    assert "GreaterThan(date" in df._jdf.queryExecution().toString()


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    assert warehouse.read_manifest(spark, path) is None and warehouse.is_stale(warehouse.age_hours(spark, None))
    warehouse.write_manifest(spark, path, period="5y", n_tickers=2, tickers=["A", "B"])
    m = warehouse.read_manifest(spark, path)
    assert (m["period"], m["n_tickers"], m["tickers"]) == ("5y", 2, ["A", "B"])
    assert not warehouse.is_stale(warehouse.age_hours(spark, m)) and warehouse.is_stale(24.1)


def test_tables_are_made_once(spark):
    for _ in range(2):
        warehouse.create_tables(spark, "lake_test")
    assert spark.table("lake_test.fundamentals").count() == 0
    spark.sql("DROP DATABASE lake_test CASCADE")
    m = spark.createDataFrame([("SP500", "A", None), ("SP500", "B", dt.date(2020, 1, 1)), ("X", "C", None)], "index_name string, ticker string, date_removed date")
    assert [r[0] for r in warehouse.current_members(m, "SP500").collect()] == ["A"]


def test_jdbc_in_ranges(spark, tmp_path):
    """Against the database that Spark ships: four tasks read, filters reach it, rows without the column are not lost."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("n"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"), (F.col("id") * 0.5).alias("x"))
    files.write_jdbc(rows, url, "bars", partitions=2, driver=driver)
    for column in ("n", "d"):
        got = files.read_jdbc_parts(spark, url, "bars", column, 4, driver=driver)
        assert got.rdd.getNumPartitions() == 4 and got.count() == 1000
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 400
    some = got.where(F.col("n") >= 990)
    assert some.count() == 10 and "PushedFilters: [*IsNotNull(n), *GreaterThanOrEqual(n,990)]" in some._jdf.queryExecution().executedPlan().toString()
    files.write_jdbc(rows.where("n < 10"), url, "few", driver=driver)
    assert files.read_jdbc_parts(spark, url, "few", "n", 4, driver=driver).agg(F.sum("x")).first()[0] == 19.0
    files.write_jdbc(rows.where("false"), url, "no_bars", driver=driver)
    assert files.read_jdbc_parts(spark, url, "no_bars", "n", 4, driver=driver).count() == 0
