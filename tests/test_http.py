"""Sources over HTTP against a server of our own that counts what it is asked, and when."""

import datetime as dt
import http.server
import threading
import time
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from marketlake.operators import ingest
from marketlake.sources.http import HttpDays, HttpDocuments, _keys


class Server:
    def __init__(self):
        self.asked, self.today, self.down = [], "2020-01-03", set()
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                name, query = url.path.strip("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
                outer.asked.append((name, time.time(), query))
                code, body = 503 if name in outer.down else 200, outer.today if name == "today" else outer.days(query)
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.server.server_port}"

    @staticmethod
    def days(query):
        if "from" not in query:
            return "x"
        first, last = (dt.date.fromisoformat(query[k]) for k in ("from", "to"))
        days = [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]
        return "Date,Open,High,Low,Close,Volume\n" + "\n".join(f"{d},1,2,0.5,1.5,10" for d in days)


@pytest.fixture
def server(spark):
    spark.dataSource.register(HttpDocuments)
    spark.dataSource.register(HttpDays)
    s = Server()
    yield s
    s.server.shutdown()


def names(server):
    return sorted(n for n, _, _ in server.asked)


def test_keys_with_days():
    assert _keys("A, B:2019-12-31,a:b,C:2020") == [("A", None), ("B", dt.date(2019, 12, 31)), ("a:b", None), ("C:2020", None)]


def test_filters_are_pushed_into_requests(spark, server):
    """Shards that end before `since` are never fetched, nor are other keys than those asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: spark.read.format("http_documents").option("pushdown", "true").option("template", server.root + "/{key}").option("keys", "a:2018-12-31,b:2019-12-31,c:2020-12-31,d").load()
        assert read().count() == 4 and names(server) == ["a", "b", "c", "d"]
        for keep, want in [
            (F.col("last_day") >= F.lit("2019-06-01").cast("date"), ["b", "c"]), (F.col("key").isin("a", "d"), ["a", "d"]), ((F.col("key") == "c") & (F.col("last_day") < F.lit("2020-01-01").cast("date")), []),
            (F.col("last_day").isNull(), ["a", "b", "c", "d"]),  # no comparison: Spark filters what was read
        ]:
            server.asked.clear()
            got = sorted(r["key"] for r in read().where(keep).collect())
            assert names(server) == want, keep
            assert got == (want if len(want) < 4 else ["d"])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_all_tasks_share_one_rate(spark, server):
    """48 keys in 4 tasks at 30 a second, one in four asked twice: no second holds more than 30 requests."""
    server.down = {f"k{n}" for n in range(0, 48, 4)}
    keys = ",".join(f"k{n}" for n in range(48))
    read = spark.read.format("http_documents").option("template", server.root + "/{key}").option("keys", keys).option("rate", "30").option("tasks", "4").option("attempts", "2").option("backoff", "0.001")
    assert read.load().groupBy("status").count().collect()
    at = sorted(t for _, t, _ in server.asked)
    assert len(at) == 60 and at[-1] - at[0] > 1.5
    assert all(at[n + 31] - at[n] > 0.95 for n in range(len(at) - 31))


def test_stream_of_days_survives_a_broken_run(spark, server, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(keys, ok=True):
        rows = spark.readStream.format("http_days").option("template", server.root + "/{key}?from={from}&to={to}").option("keys", keys).option("since", "2019-12-31").option("until", server.root + "/today").option("attempts", "1").load()
        bars = ingest.csv_bars(rows.select("key", "body"))
        q = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        try:
            q.processAllAvailable()
            assert ok
        except Exception:
            assert not ok
        finally:
            q.stop()

    def bars():
        return sorted((r["ticker"], r["date"].day) for r in spark.read.parquet(out).collect())

    run("A,B")
    assert bars() == [(t, d) for t in "AB" for d in (1, 2, 3)]
    server.today, server.down = "2020-01-05", {"B"}
    run("A,B", ok=False)  # A was read, B fails: nothing of the batch counts
    server.down = set()
    run("A,B,C")  # the batch is read again as it was planned; a new key begins at the beginning
    server.today = "2020-01-06"
    run("A,B,C")
    assert bars() == [(t, d) for t in "ABC" for d in (1, 2, 3, 4, 5, 6)]
    spans = [(n, q["from"], q["to"]) for n, _, q in server.asked if n == "A"]
    assert spans.count(("A", "2020-01-01", "2020-01-03")) == 1 and ("A", "2020-01-06", "2020-01-06") in spans
