import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.functions.numeric import flag_one, half_even, present, ratio, text_or_null, to_float
from marketlake.operators import bars as ops
from marketlake.operators import fundamentals as fu
from marketlake.operators import indicators as ind
from marketlake.operators import insider, lookup, news, options, regime, signals
from marketlake.operators import membership as mem
from marketlake.plans import history
from marketlake.sources import archive, files, warehouse
from tests.oracle import SF

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def panel(spark, closes, ticker="A", volume=100.0):
    return spark.createDataFrame([(ticker, day(i), c, c + 1.0, c - 1.0, c, volume) for i, c in enumerate(closes)], BARS)


def test_numbers(spark):
    r = spark.range(1).select(
        present(F.lit(float("nan"))), ratio(F.lit(1.0), F.lit(0.0)), half_even(F.lit(0.125), 2), to_float(F.lit("x")), to_float(F.lit("1.5")),
        flag_one(F.lit("true")), flag_one(F.lit(" 1 ")), text_or_null(F.lit("\n  ")),
    ).first()
    assert tuple(r) == (None, None, 0.12, None, 1.5, False, True, None)


def test_cleaning_drops_each_kind_of_bad_row(spark):
    good = [("A", day(i), 2.0, 3.0, 1.0, 2.0, 0.0) for i in range(3)]
    bad = [
        ("A", day(10), 2.0, 3.0, 1.0, None, 1.0), ("A", day(11), 2.0, 3.0, 1.0, math.nan, 1.0), ("A", day(12), 2.0, 3.0, 1.0, 0.0, 1.0),
        ("A", day(13), 2.0, 1.0, 3.0, 2.0, 1.0), ("A", day(14), None, 3.0, 1.0, 2.0, 1.0), ("A", day(15), None, None, None, None, None), ("B", day(1), 2.0, 3.0, 1.0, 2.0, 1.0),
    ]
    df = spark.createDataFrame(good + bad, BARS)
    assert ops.clean(df, least=3).count() == 3
    assert ops.clean(df, least=4).count() == 0
    assert ops.clean(df, positive_volume=True, least=1).count() == 1


def test_wide_and_back(spark):
    b = panel(spark, [1.0, 2.0]).unionByName(panel(spark, [5.0], "B"))
    back = ops.as_long(ops.as_wide(b, ["A", "B"])).where("close is not null")
    assert sorted(map(tuple, back.select("ticker", "date", "close").collect())) == [("A", day(0), 1.0), ("A", day(1), 2.0), ("B", day(0), 5.0)]


def test_fetch_lists(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "ticker string")
    renames = spark.createDataFrame([("C", "CC", "active"), ("D", "DD", "gone")], files.RENAMES)
    assert {r[0] for r in ops.to_fetch(t("A", "B", "C", "D"), t("A"), t("C", "D"), renames).collect()} == {"B", "C"}
    assert ops.newer(panel(spark, [1.0, 2.0, 3.0]), panel(spark, [1.0])).count() == 2
    found = ops.under_old_names(panel(spark, [1.0], "CC"), renames)
    assert [r["ticker"] for r in found.collect()] == ["C"]
    assert ops.trim_to(panel(spark, [1.0, 2.0, 3.0]), panel(spark, [1.0, 2.0])).count() == 2
    assert ops.jaccard(t(), t()).first()["similarity"] == 1.0
    assert ops.cache_valid(0.9, 24.0, True) and not ops.cache_valid(0.89, 1.0, True) and not ops.cache_valid(1.0, None, True)


def test_rsi_edges(spark):
    rsi = lambda c: [r[0] for r in ind.exponential(panel(spark, c)).orderBy("date").select("rsi").collect()]
    assert set(rsi([float(i) for i in range(40)])) == {50.0}  # a pure rise has no loss
    r = rsi([1.0, 2.0, 1.0] * 10)
    assert set(r[:14]) == {50.0} and r[14] != 50


def test_indicators_follow_pandas(spark):
    rng = np.random.default_rng(1)
    c = pd.Series(100 + rng.standard_normal(120).cumsum())
    b = panel(spark, c.tolist())
    x = ind.add_williams_r(ind.add_obv(ind.add_bollinger(ind.exponential(b)))).orderBy("date").toPandas()
    mid, dev = c.rolling(20).mean(), c.rolling(20).std()
    np.testing.assert_allclose(x["pct_b"].astype(float), (c - (mid - 2 * dev)) / (4 * dev), rtol=1e-9)
    np.testing.assert_allclose(x["obv"], (np.sign(c.diff()).fillna(0) * 100).cumsum())
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(x["macd_hist"], macd - macd.ewm(span=9, adjust=False).mean(), atol=1e-9)
    assert x["atr"].isna().sum() == 13
    assert x["williams_r"][:13].eq(-50).all() and x["williams_r"].between(-100, 0).all()


def test_flat_series_has_no_pct_b(spark):
    x = ind.add_bollinger(panel(spark, [5.0] * 20)).toPandas()
    assert x["pct_b"].isna().all() and x["bb_mid"].notna().sum() == 1


def test_atr_percentile_needs_twenty(spark):
    x = ind.atr_percentile(ind.exponential(panel(spark, [float(i % 7) + 2 for i in range(30)]))).first()
    assert (x["atr_percentile"], x["atr_regime"]) == (50.0, "normal")


def test_signal_guard(spark):
    rng = np.random.default_rng(2)
    c = (100 + rng.standard_normal(205).cumsum()).tolist()
    both = panel(spark, c).unionByName(panel(spark, c[:204], "B"))
    r = {x["ticker"]: x for x in signals.signals_universe(both).collect()}
    assert r["A"]["error"] is None and 0 <= r["A"]["signal_score"] <= 10
    assert r["B"]["error"] == "Not enough historical data" and r["B"]["signal_score"] is None
    assert signals.signals_universe(both, ["A", "none"]).count() == 1


def test_regime_rules(spark):
    rows = [(day(0), 19.9, 0.01, None), (day(1), 20.0, 0.0, 0.6), (day(2), 31.0, -0.03, 0.7), (day(3), 30.0, None, None)]
    got = {r["date"]: r for r in regime.classify(spark.createDataFrame(rows, "date date, vix double, slope double, breadth double")).collect()}
    assert [got[day(i)]["regime"] for i in range(4)] == ["bull", "neutral", "bear", "neutral"]
    assert got[day(3)]["vix_signal"] == "neutral" and got[day(0)]["breadth_signal"] == "unknown"
    asked = spark.createDataFrame([(day(-1),), (day(1),), (day(9),)], "date date")
    of = regime.as_of(asked, spark.createDataFrame([(day(0), "bull"), (day(2), "bear")], "date date, regime string"))
    assert sorted(map(tuple, of.collect())) == [(day(-1), "neutral"), (day(1), "bull"), (day(9), "bear")]
    with pytest.raises(ValueError):
        regime.align()


def test_detect_from_bars(spark):
    b = panel(spark, [15.0, 40.0, 25.0], "^VIX").unionByName(panel(spark, [100.0] * 3, "SPY"))
    got = {r["date"]: r for r in regime.detect(b, str(day(1)), str(day(2)), universe=b).collect()}
    assert sorted(got) == [day(1), day(2)]
    assert (got[day(1)]["vix_signal"], got[day(1)]["slope_signal"], got[day(1)]["breadth_signal"]) == ("bear", "unknown", "bear")
    assert got[day(1)]["regime"] == "bear" and got[day(2)]["vix_signal"] == "neutral"


def test_breadth_counts_warm_up_as_below(spark):
    b = panel(spark, [1.0, 2.0, 3.0]).unionByName(panel(spark, [1.0], "B")).unionByName(panel(spark, [9.0, 1.0], "C"))
    got = {r["date"]: r["breadth"] for r in regime.breadth(b, days=2).collect()}
    assert got == {day(0): 0.0, day(1): 0.5}  # on the third day one of three tickers is there


def state_machine(snapshots, changes):
    """Intervals by one pass in order, as the definition reads."""
    open_, out, prev = {}, [], set()
    for d, now in snapshots:
        for t in sorted(prev - now):
            out.append((t, open_.pop(t), d))
        for t in now - prev:
            open_[t] = d
        prev = now
    for d, add, remove in changes:
        for t in remove:
            out.append((t, open_.pop(t, d), d))
        for t in add:
            open_[t] = d
    return sorted(out + [(t, d, None) for t, d in open_.items()], key=repr)


def test_membership_equals_a_state_machine(spark):
    rng = random.Random(3)
    names = [f"T{i}" for i in range(12)]
    snaps = [(day(3 * i), {t for t in names if rng.random() < 0.6}) for i in range(15)]
    changes = [(day(60 + i // 2), rng.sample(names, rng.randint(0, 2)), rng.sample(names, rng.randint(0, 2))) for i in range(30)]
    s = spark.createDataFrame([(d, sorted(t)) for d, t in snaps], "date date, tickers array<string>")
    c = spark.createDataFrame([(d, i, ",".join(a), ",".join(r)) for i, (d, a, r) in enumerate(changes)], "date date, nth long, add string, remove string")
    got = mem.intervals(mem.snapshot_events(s).unionByName(mem.change_events(c)))
    assert sorted(map(tuple, got.collect()), key=repr) == state_machine(snaps, changes)


def test_membership_ends(spark):
    m = spark.createDataFrame([("A", day(0), day(5)), ("B", day(2), None)], files.MEMBERS)
    assert {r[0] for r in mem.members_as_of(m, str(day(5))).collect()} == {"B"}
    assert {r[0] for r in mem.members_between(m, str(day(5)), str(day(9))).collect()} == {"A", "B"}
    gone = spark.createDataFrame([("A",)], "ticker string")
    r = mem.coverage_gap(m, gone, str(day(1)), str(day(4))).first()
    assert (r["total_days"], r["missing_days"]) == (5, 3)
    assert mem.coverage_gap(m, gone, "1990-01-01", "1990-02-01").first()["missing_pct"] == 0.0
    with pytest.raises(NotImplementedError):
        mem.tickers_of(m, "dax40", day="2020-01-01")
    with pytest.raises(ValueError):
        mem.tickers_of(m, "nope")


def test_many_intervals_of_one_ticker(spark):
    """Every other day of 200,000 is in, by 100,000 intervals, and all of them again as one that never ends on another ticker."""
    d = lambda n: F.date_add(F.lit("1600-01-01").cast("date"), n.cast("int"))
    m = spark.range(100_000).select(F.lit("A").alias("ticker"), d(F.col("id") * 2).alias("date_added"), d(F.col("id") * 2 + 1).alias("date_removed"))
    m = m.unionByName(spark.range(1000).select(F.lit("B").alias("ticker"), d(F.col("id")).alias("date_added"), F.lit(None).cast("date").alias("date_removed")))
    bars = spark.range(200_000).select(F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("ticker"), d(F.col("id")).alias("date"))
    got = {r["ticker"]: r["count"] for r in mem.bars_in_universe(bars, m).groupBy("ticker").count().collect()}
    assert got == {"A": 100_000, "B": 200_000}


def test_overlaps_follow_each_interval(spark):
    rng = random.Random(5)
    spans = [(t, day(a), rng.choice([None, day(a + rng.randint(-2, 40))])) for t in "AB" for a in (rng.randint(0, 300) for _ in range(6))]
    spans = [s for s in spans if s[2] or s[0] == "B"]
    bars = spark.createDataFrame([(t, day(n)) for t in "ABC" for n in range(-5, 350)], "ticker string, date date")
    got = {tuple(r) for r in mem.bars_in_universe(bars, spark.createDataFrame(spans, files.MEMBERS), 7).collect()}
    assert got == {(t, d) for t, d in map(tuple, bars.collect()) if any(t == s and a <= d and (r is None or d < r) for s, a, r in spans)}


def test_ticker_tokens(spark):
    r = spark.createDataFrame([("brk.b, ABC-200006 ,,abc",)], "c string").select(mem.historic_tickers(F.col("c"))).first()[0]
    assert r == ["BRK-B", "ABC"]
    cells = spark.createDataFrame([("BRK.B",), ("[1]",), ("123",), (" ",), ("A" * 16,), ("X",)], "cell string")
    assert [x[0] for x in mem.scraped_tickers(cells, "sp500").collect()] == ["BRK", "X"]
    assert [x[0] for x in mem.scraped_tickers(cells, "dax40").collect()] == ["BRK.DE", "X.DE"]


FACT = "ticker string, metric string, value double, unit string, fiscal_year int, fiscal_period string, period_start date, period_end date, filed_date date, form_type string, nth int"


def fact(value, start, end, filed=100, fp="Q1", form="10-Q", nth=0):
    return ("A", "M", value, "USD", 2020, fp, None if start is None else day(start), day(end), day(filed), form, nth)


def test_fundamentals_two_stages(spark):
    rows = [fact(1.0, 0, 270), fact(2.0, 0, 91), fact(3.0, 0, 90, filed=200), fact(4.0, 0, 91, form=None), fact(5.0, None, 80, form="10-K", fp="FY"), fact(6.0, 0, 95, form="10-K", fp="FY"), fact(7.0, 0, 90, form="10-Q/A")]
    got = fu.first_filed(fu.one_per_filing(fu.complete(spark.createDataFrame(rows, FACT))))
    assert sorted((r["form_type"], r["value"]) for r in got.collect()) == [("10-K", 6.0), ("10-Q", 2.0), ("10-Q/A", 7.0)]


def test_fundamentals_stages_at_once(spark):
    """The one aggregate against the two stages, over keys with and without facts that lack a start; columns that nobody
    asks for are not read, so they are not shuffled."""
    rng = random.Random(3)
    rows = [fact(float(i), rng.choice([None, *range(0, 90, 9)] if i % 2 else [0, 30]), 91 + rng.randint(0, 3), 100 + rng.randint(0, 2), rng.choice(["FY", "Q1"]), rng.choice(["10-K", "10-Q", None]), i) for i in range(300)]
    rows = [(rng.choice(["A", "B", "C", None]), rng.choice("MN"), *r[2:]) for r in rows]
    facts = fu.complete(spark.createDataFrame(rows, FACT).repartition(7))
    want = fu.first_filed(fu.one_per_filing(facts)).drop("nth")
    for dealt in (facts, fu.by_key(facts), fu.by_key(facts, 3)):
        got = fu.earliest(dealt)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    used = history.fundamentals_upsert(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" in used and "l_extendedprice" not in used and "l_partkey" not in used


def test_upsert_twice(spark, tmp_path):
    rows = spark.createDataFrame([fact(1.0, 0, 91)], FACT)
    path = str(tmp_path / "facts")
    assert fu.upsert(rows, path) == {"attempted": 1, "inserted": 1}
    assert fu.upsert(rows, path) == {"attempted": 1, "inserted": 0}
    assert fu.upsert(spark.createDataFrame([fact(1.0, 0, 91, fp="Q2")], FACT), path)["inserted"] == 1
    assert fu.duplicate_keys(spark.read.parquet(path)).count() == 0


def test_odd_documents_keep_what_is_sound(spark):
    seen = '{"val": %s, "fy": 2020, "fp": "FY", "start": "2020-01-01", "end": "2020-12-31", "filed": "2021-02-01", "form": "10-K"}'
    odd = '{"facts": {"us-gaap": {"Assets": {"units": {"USD": [%s, 7, {"val": "x", "fy": []}], "EUR": [%s], "odd": "none", "obj": {"a": 1}}}, "Goodwill": 5, "Liabilities": {"units": []}}, "dei": {"Shares": {"units": {"n": [%s]}}}}}'
    docs = [("A", 1, odd % (seen % "1.5", seen % "2", seen % "3")), ("B", 2, "{"), ("C", 3, None), ("D", 4, '{"facts": [1]}'), ("E", 5, "")]
    df = spark.createDataFrame(docs, "ticker string, cik int, body string")
    rows = sorted(fu.facts(df).collect(), key=lambda r: r["nth"])
    assert [(r["unit"], r["value"], r["fiscal_year"], r["nth"]["unit_nth"]) for r in rows] == [("USD", 1.5, 2020, 0), ("USD", None, None, 0), ("USD", None, None, 0), ("EUR", 2.0, 2020, 1)]
    # of two units with the same fact the first of the document counts, though its name sorts after the other's
    assert [(r["ticker"], r["unit"], r["value"]) for r in fu.parse(df).collect()] == [("A", "USD", 1.5)]
    every = fu.observations(fu.tags(df, None)).groupBy("taxonomy", "source_tag", "unit").count().collect()
    assert sorted(map(tuple, every)) == [("dei", "Shares", "n", 1), ("us-gaap", "Assets", "EUR", 1), ("us-gaap", "Assets", "USD", 3)]


def test_upsert_of_nothing_and_repeats(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([fact(1.0, 0, 91), fact(2.0, 0, 92)], FACT)
    assert fu.upsert(rows, path) == {"attempted": 2, "inserted": 1}
    assert fu.upsert(rows.where("false"), path) == {"attempted": 0, "inserted": 0}
    assert spark.read.parquet(path).count() == 1


def test_bucketed_facts_are_not_shuffled(spark):
    warehouse.create_tables(spark, "facts_test", buckets=4)
    name = "facts_test.fundamentals"
    spark.sql(f"TRUNCATE TABLE {name}")
    ids = spark.range(200)
    new = ids.selectExpr("concat('T', id % 50) ticker", "'M' metric", "double(id) value", "'USD' unit", "int(2000 + id % 3) fiscal_year", "'FY' fiscal_period",
                         "date'2020-01-01' period_start", "date'2020-12-31' period_end", "date'2021-02-01' filed_date", "'10-K' form_type", "1 extra")
    keys = new.select(*fu.KEY).distinct().count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert fu.insert_absent(new, name) == {"attempted": 200, "inserted": keys}
        more = new.unionByName(new.limit(1).withColumn("ticker", F.lit("NEW")))
        plan = fu.absent(fu.by_buckets(more, name), spark.table(name))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan  # that of the new rows
        files = len(spark.table(name).inputFiles())
        assert fu.insert_absent(more, name) == {"attempted": 201, "inserted": 1}
        assert len(spark.table(name).inputFiles()) == files + 1  # the one bucket that is touched
        assert fu.insert_absent(more, name)["inserted"] == 0 and fu.duplicate_keys(spark.table(name)).count() == 0
        names = spark.createDataFrame([("M", "a metric")], "metric string, title string")
        joined = spark.table(name).groupBy(*fu.KEY).count().join(F.broadcast(names), "metric")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP DATABASE facts_test CASCADE")


def test_reconcile_counts_nulls_as_different(spark):
    a = spark.createDataFrame([fact(1.0, 0, 91)], FACT).withColumn("source_tag", F.lit("t"))
    assert fu.mismatches(a, a).count() == 0
    b = a.withColumn("unit", F.lit(None).cast("string"))
    assert fu.mismatches(b, b).count() == 1


def test_ids_grow(spark):
    known = spark.createDataFrame([(4, "x")], "id int, name string")
    names = spark.createDataFrame([("x",), ("b",), ("a",), (None,)], "name string")
    assert sorted(map(tuple, fu.with_ids(names, known, "name").collect())) == [(4, "x"), (5, "a"), (6, "b")]


FORM = """<ownershipDocument>{o}<nonDerivativeTable>
<nonDerivativeTransaction><transactionDate><value>2020-01-02</value></transactionDate><transactionAmounts><transactionShares><value>10</value></transactionShares>
<transactionPricePerShare><footnoteId id="F1"/></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionCoding><transactionCode>S</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
OWNER = "<reportingOwner><reportingOwnerId><rptOwnerName>{n}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>{f}</isOfficer></reportingOwnerRelationship></reportingOwner>"


def test_form_4(spark):
    docs = [FORM.format(o=OWNER.format(n="A", f="1") + OWNER.format(n="B", f="true")), FORM.format(o=""), "<ownershipDocument><nonDeriv"]
    df = spark.createDataFrame([("T", 1, str(i), "2020-01-03", d) for i, d in enumerate(docs)], "ticker string, cik int, accession_number string, filing_date string, body string")
    rows = insider.transactions(df).collect()
    assert sorted((r["accession_number"], r["insider_name"] or "", r["transaction_index"]) for r in rows) == [("0", "A", 0), ("0", "A", 1), ("0", "B", 0), ("0", "B", 1), ("1", "", 0), ("1", "", 1)]
    first = next(r for r in rows if r["insider_name"] == "A" and r["transaction_index"] == 0)
    assert first["price_per_share"] is None and first["shares"] == 10.0 and first["is_officer"]
    assert not next(r for r in rows if r["insider_name"] == "B")["is_officer"]


def test_older_shards(spark):
    body = '{"filings": {"recent": {"form": ["4"], "accessionNumber": ["1-2"], "filingDate": ["2020-05-01"], "primaryDocument": ["x/d.xml"]}, "files": [{"name": "old", "filingTo": "2019-01-01"}, {"name": "mid", "filingTo": "2020-04-01"}]}}'
    s = spark.createDataFrame([("A", 7, body)], "ticker string, cik int, body string")
    names = lambda since: sorted(r["name"] for r in insider.older_shards(s, since).collect())
    assert names(None) == ["mid", "old"] and names("2020-01-01") == ["mid"] and names("2020-06-01") == []
    assert insider.form_path(insider.filing_index(s)).first()["path"] == "7/12/d.xml"


CONTRACT = "ticker string, expiration string, option_type string, strike double, volume long, open_interest long, implied_volatility double, contract_symbol string, underlying_price double"


def test_options_edges(spark):
    c = lambda side, strike, v, oi, iv=0.2, exp="2020-02-01", t="A": (t, exp, side, strike, v, oi, iv, f"{side}{strike}", 100.0)
    rows = [c("put", 99.0, 50, 10, None), c("put", 98.0, None, 10), c("put", 97.0, 0, 10, 0.4), c("put", 50.0, 0, 0, 9.0), c("call", 100.0, 50, 10), c("put", 1.0, 9, 9, exp="2021-01-01"), c("put", 1.0, 5, 1, t="B"), c("put", 1.0, 5, 1, t="C", exp="2020-01-02")]
    got = {r["ticker"]: r for r in options.snapshots(spark.createDataFrame(rows, CONTRACT), "2020-01-01").collect()}
    assert got["A"]["pcr_volume"] == 1.0 and got["A"]["signal"] == "bullish" and got["A"]["expirations_used"] == 1
    assert abs(got["A"]["avg_put_iv"] - 0.3) < 1e-12
    assert got["B"]["pcr_volume"] is None and got["B"]["signal"] == "neutral" and got["B"]["unusual_activity"]
    assert got["C"]["error"] == "no_valid_expirations"
    r = spark.createDataFrame([(1.5, False), (1.0, False), (1.0, True), (0.5, False), (0.6, False), (None, True)], "p double, u boolean").select(options.signal(F.col("p"), F.col("u"))).collect()
    assert [x[0] for x in r] == ["strong_bullish", "bullish", "strong_bullish", "bearish", "neutral", "neutral"]


def test_a_date_that_is_none_does_not_end_a_scan(spark):
    body = '{"price": 1.0, "expirations": ["2020-02-01", "never"], "chains": [{"expiration": "never", "calls": [{"strike": 1.0, "volume": 9.0}]}, {"expiration": "2020-02-01", "calls": [{"strike": 1.0, "volume": 4.0}], "puts": [{"strike": 2.0, "volume": 8.0}]}]}'
    p = spark.createDataFrame([("A", body, None), ("B", "no json", None)], "ticker string, body string, error string")
    snaps, live = options.scan(p, "2020-01-01")
    got = {r["ticker"]: r for r in snaps.collect()}
    assert (got["A"]["expirations_used"], got["A"]["pcr_volume"], got["B"]["error"]) == (1, 2.0, "no_price")
    assert sorted((r["option_type"], r["strike"]) for r in live.collect()) == [("call", 1.0), ("put", 2.0)]


def test_an_answer_in_pages_is_one_row(spark):
    page = lambda e, side, v: f'{{"price": 10.0, "expirations": ["{e}"], "chains": [{{"expiration": "{e}", "{side}s": [{{"strike": 9.0, "volume": {v}}}]}}]}}'
    pages = [("A", page("2020-02-01", "call", 4.0), None), ("A", page("2020-02-01", "put", 6.0), None), ("A", page("2020-02-08", "put", 2.0), None), ("A", None, "HTTP 503"), ("B", None, "HTTP 503"), ("B", None, "HTTP 500")]
    snaps, live = options.scan(spark.createDataFrame(pages, "ticker string, body string, error string"), "2020-01-01")
    got = {r["ticker"]: r for r in snaps.collect()}
    assert snaps.count() == 2 and live.count() == 3
    assert (got["A"]["price"], got["A"]["expirations_used"], got["A"]["pcr_volume"], got["A"]["error"], got["B"]["error"]) == (10.0, 2, 2.0, None, "HTTP 500")


def test_last_entry_of_the_map_counts(spark):
    body = '{"0": {"ticker": "a", "cik_str": 9}, "1": {"ticker": "B", "cik_str": 5}, "2": {"ticker": "A", "cik_str": 3}}'
    got = fu.cik_map(spark.createDataFrame([(body,)], "body string"))
    assert {r["ticker"]: r["cik"] for r in got.collect()} == {"A": 3, "B": 5}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_entry_of_the_map_carries_its_document(spark):
    bodies = ['{"0": {"ticker": "a", "cik_str": 1}, "1": {"ticker": "b", "cik_str": 2}}', '{"1": {"ticker": "A", "cik_str": 7}}', '{"0": {"ticker": "a", "cik_str": 4}}', "none", None]
    got = fu.cik_map(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert {r["ticker"]: r["cik"] for r in got.collect()} == {"A": 7, "B": 2}
    kept = re.search(r"Generate posexplode\(.*\), \[([^\]]*)\]", plan_of(got)).group(1)
    assert "rank" in kept and "body" not in kept


def test_ownership_lines_are_shuffled_as_rows(spark):
    plan = plan_of(history.insider_xml(spark, SF))
    assert "SortAggregate" not in plan and "ownershipDocument" not in plan[plan.rindex("Exchange") :]
    assert not re.search("nonDerivativeTransaction><transactionDate", plan[plan.rindex("ObjectHashAggregate") :])


def test_ownership_bodies_that_are_cut_short_give_no_rows(spark):
    whole = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>\t\n P\r </transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    bodies = [whole, whole + " \n ", whole.replace("</ownershipDocument>", "</ownershipDocument >"), whole[:-1], whole[:-25], "/x>", "", None]
    docs = spark.createDataFrame([("T", 1, str(i), "2000-01-01", b) for i, b in enumerate(bodies)], "ticker string, cik int, accession_number string, filing_date string, body string")
    assert sorted((r["accession_number"], r["transaction_code"]) for r in insider.transactions(docs).collect()) == [("0", "P"), ("1", "P"), ("2", "P")]


def test_tasks_of_an_audit_grow_with_the_rows(spark):
    audit = plan_of(history.dup_audit(spark, SF))
    assert audit.count("REPARTITION_BY_NUM") == 2 and audit.index("REPARTITION_BY_NUM") > audit.rindex("HashAggregate")


def test_news_dedup_keeps_nulls_and_tickers(spark):
    rows = [("A", 1, day(1)), ("A", 1, day(0)), ("B", 1, day(1)), ("A", None, day(0)), ("A", None, day(1))]
    df = spark.createDataFrame(rows, "ticker string, article_id long, snapshot_date date").withColumn("published_at", F.lit(None).cast("timestamp"))
    assert sorted((r[0], r[1] or 0, r[2]) for r in news.dedup(df).select("ticker", "article_id", "snapshot_date").collect()) == [("A", 0, day(0)), ("A", 0, day(1)), ("A", 1, day(0)), ("B", 1, day(1))]


def test_archive_replaces_one_day(spark, tmp_path):
    path = str(tmp_path / "a")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert archive.save_snapshot(one, path, "2020-01-01") and archive.save_snapshot(one, path, "2020-01-02") and archive.save_snapshot(two, path, "2020-01-02")
    assert not archive.save_snapshot(one.where("false"), path, "2020-01-03")
    assert sorted(r["x"] for r in archive.load_archive(spark, path).collect()) == [1, 2, 3]
    some = archive.load_archive(spark, path, start="2020-01-02", end="2020-01-02")
    assert sorted(r["x"] for r in some.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(snapshot_date" in some._jdf.queryExecution().toString()
    assert archive.archive_summary(spark, path).first()["days"] == 2


def test_sector_cache(spark):
    cache = spark.createDataFrame([("A", "Tech", 5.0, dt.datetime(2020, 1, 1)), ("B", None, None, dt.datetime(2020, 1, 9))], "ticker string, sector string, market_cap double, fetched_at timestamp")
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    assert sorted((r[0], r[1]) for r in lookup.sectors_and_caps(asked, cache).collect()) == [("A", "Tech"), ("B", "Unknown"), ("C", "Unknown")]
    assert {r[0] for r in lookup.stale_or_missing(asked, cache, "2020-01-10", 48).collect()} == {"A", "C"}


def test_html_tables(spark):
    html = "<table><tr><th>X</th></tr></table><p><table><tr><th>Symbol</th><th>Name</th></tr><tr><td>AB <b>C</b></td><td>n</td></tr><tr><td></td><td>m</td></tr></table>"
    p = spark.createDataFrame([("1", html), ("2", None)], "page string, html string")
    assert [r["cell"] for r in files.html_column(p, "Symbol").collect()] == ["AB C"]
    assert files.html_column(p, "Symbol", table=0).count() == 0


def test_csv_files(spark, tmp_path):
    m = spark.createDataFrame([("B", day(0), None), ("A", day(1), day(2))], files.MEMBERS)
    files.write_csv(m, str(tmp_path / "m"), "ticker", "date_added")
    assert [r["ticker"] for r in files.read_csv(spark, str(tmp_path / "m"), files.MEMBERS).orderBy("ticker").collect()] == ["A", "B"]
    with pytest.raises(RuntimeError):
        files.write_csv(m.where("false"), str(tmp_path / "n"))


def test_time_zones_and_point_lookup(spark):
    at = spark.createDataFrame([("A", "2020-01-02 01:30:00")], "ticker string, d string").select("ticker", F.col("d").cast("timestamp_ntz").alias("date"))
    assert ops.in_utc(at, "Europe/Athens").first()["date"] == dt.datetime(2020, 1, 1, 23, 30)
    assert ops.in_utc(at).first()["date"] == dt.datetime(2020, 1, 2, 1, 30)
    b = panel(spark, [2.0, 1.0]).unionByName(panel(spark, [5.0], "B")).unionByName(spark.createDataFrame([("A", day(9), None, math.nan, None, None, None)], BARS))
    assert [r["close"] for r in ops.of_ticker(b, "A").collect()] == [2.0, 1.0]


def test_lists_and_sectors_with_an_age(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "ticker string")
    old, new = t("A"), t("B")
    assert lookup.listed(old, 1.0, new) == (old, False) and lookup.listed(old, 200.0, new) == (new, True)
    assert lookup.listed(old, 200.0, None) == (old, False) and lookup.listed(None, None, new) == (new, True)
    with pytest.raises(RuntimeError):
        lookup.listed(None, None, None)
    cache = spark.createDataFrame([("A", "Tech", 1.0, dt.datetime(2020, 1, 1)), ("Z", "Old", 2.0, dt.datetime(2020, 1, 1))], "ticker string, sector string, market_cap double, fetched_at timestamp")
    got = spark.createDataFrame([("A", None, None, False), ("B", "", 3.0, True), ("C", "Oil", None, True), ("Q", "x", 1.0, True)], "ticker string, sector string, market_cap double, ok boolean")
    out = {r["ticker"]: (r["sector"], r["market_cap"]) for r in lookup.refresh_sectors(t("A", "B", "C"), cache, got, "2020-02-01").collect()}
    assert out == {"A": ("Tech", 1.0), "B": ("Unknown", 3.0), "C": ("Oil", None), "Z": ("Old", 2.0)}


def test_insider_run_passes_over_what_is_broken(spark):
    index = '{"filings": {"recent": {"form": ["4", "4", "4", "8-K"], "accessionNumber": ["0-1", "0-2", "0-3", "0-4"], "filingDate": ["2020-01-02", "2020-01-03", "2019-01-01", "2020-01-04"], "primaryDocument": ["x/d.xml", "d.xml", "d.xml", "d.xml"]}}}'
    subs = spark.createDataFrame([("A", 7, index)], "ticker string, cik int, body string")
    xml = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2020-01-01</value></transactionDate></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    docs = spark.createDataFrame([("7/01/d.xml", xml), ("7/02/d.xml", "<broken"), ("7/03/d.xml", xml)], "path string, body string")
    assert [r["accession_number"] for r in insider.run(subs, docs, since="2020-01-01").collect()] == ["0-1"]


def test_readers_get_facts_in_order(spark):
    f = spark.createDataFrame([(2, day(1)), (1, day(1)), (3, day(0))], "metric_id int, period_end date")
    assert [r["metric_id"] for r in fu.in_order(f).collect()] == [3, 1, 2]


def test_scans_are_archived_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1)], "ticker string, n int")
    assert archive.save_scan(rows, str(tmp_path / "s"), "2020-01-01") and archive.save_scan(rows, str(tmp_path / "s"))
    assert archive.load_archive(spark, str(tmp_path / "s")).select("snapshot_date").distinct().count() == 2
    assert not archive.save_scan(rows.limit(0), str(tmp_path / "t"))
