import datetime as dt

from marketlake.streaming import archives, refdata

SCHEMA = "ticker string, article_id long, published_at timestamp"


def test_late_copies_are_dropped(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    rows = [("A", 1, t), ("A", 1, t), ("B", 1, t), ("A", None, t), ("A", None, t)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = archives.dedup_stream(archives.read_stream(spark, str(tmp_path / "in"), SCHEMA))
    archives.file_by_day(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.where("article_id = 1").count() == 2


def test_bars_upsert_is_idempotent(spark, tmp_path):
    schema = "ticker string, date date, close double"
    for n in range(2):
        spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0), ("B", dt.date(2020, 1, 2), 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        archives.upsert_bars(archives.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_upsert_keeps_bars_that_a_batch_does_not_hold(spark, tmp_path):
    schema = "ticker string, date date, close double, sent int"
    d, e = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [
        [("A", d, 1.0, 1), ("B", d, 2.0, 1), ("A", e, 3.0, 1)],
        [("A", d, 9.0, 2)],  # A alone: B's bar of the same day stays
        [("A", d, 7.0, 3), ("A", d, 8.0, 4), ("C", e, 4.0, 4)],  # sent twice: the newer counts
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        archives.upsert_bars(archives.read_stream(spark, str(tmp_path / "in"), schema), out, cp, newest="sent").awaitTermination()
    want = {("A", d): 8.0, ("B", d): 2.0, ("A", e): 3.0, ("C", e): 4.0}
    read = lambda: {(r["ticker"], r["date"]): r["close"] for r in spark.read.schema(schema).parquet(out).collect()}
    assert read() == want and spark.read.schema(schema).parquet(out).count() == 4
    # a batch that is replayed changes nothing; one that broke off while days were replaced ends from its staged copy
    last = spark.createDataFrame(batches[-1], schema)
    archives.merge_days(last, out, str(tmp_path / "again"), "sent")
    assert read() == want
    import shutil

    shutil.rmtree(f"{out}/date={d}")
    archives.merge_days(last, out, str(tmp_path / "again"), "sent")
    assert read() == want


def test_cached_reference_data_is_asked_for_again_when_old(spark, tmp_path):
    hour = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    asks, answers = "ticker string, at timestamp", "ticker string, at timestamp, ok boolean, sector string, market_cap double"
    r, f = str(tmp_path / "requests"), str(tmp_path / "fetched")

    def step(requests, fetched):
        """One run to the end of what there is; the next is a restart from the checkpoint."""
        spark.createDataFrame(requests, asks).coalesce(1).write.mode("append").parquet(r)
        spark.createDataFrame(fetched, answers).coalesce(1).write.mode("append").parquet(f)
        out = refdata.cached_or_asked(archives.read_stream(spark, r, asks), archives.read_stream(spark, f, answers), max_hours=24, retry_hours=1, forget_hours=1000, late="100 hours")
        had = seen()
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen() - had)

    def seen():
        try:
            rows = spark.read.parquet(str(tmp_path / "out")).collect()
        except Exception as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            return set()
        return {(x["ticker"], round((x["at"] - dt.datetime(2020, 1, 1)).total_seconds() / 3600, 2), x["status"], x["sector"]) for x in rows}

    assert step([("A", hour(0)), ("A", hour(0.5)), ("A", hour(2)), ("B", hour(0)), (None, hour(0))], []) == [
        ("A", 0, "ask", None), ("A", 0.5, "pending", None), ("A", 2, "ask", None), ("B", 0, "ask", None)]
    assert step([("A", hour(4)), ("B", hour(4))], [("A", hour(3), True, "Tech", 1.0), ("B", hour(3), False, None, None)]) == [("A", 4, "cached", "Tech"), ("B", 4, "cached", "Unknown")]
    # a day later what is old is asked for again; a fetch that fails keeps the sector and renews its age
    assert step([("A", hour(30)), ("B", hour(26))], []) == [("A", 30, "ask", None), ("B", 26, "cached", "Unknown")]
    assert step([("A", hour(32))], [("A", hour(31), False, "", None)]) == [("A", 32, "cached", "Tech")]
