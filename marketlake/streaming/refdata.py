"""Reference data with an age as keyed state: what a stream of requests finds cached, and what has to be asked for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators.lookup import UNKNOWN

STATE = "asked_us bigint, fetched_us bigint, sector string, market_cap double"
ANSWER = "ticker string, at timestamp, status string, sector string, market_cap double"
HOUR = 3_600_000_000


def cached_or_asked(requests: DataFrame, fetched: DataFrame, max_hours: float, retry_hours: float = 1.0, forget_hours: float = 24.0 * 90, late: str = "1 hour") -> DataFrame:
    """One row per request of a stream (ticker, at): status cached, with the sector and market value known at most
    max_hours; ask, where the source is to be asked; or pending, asked for at most retry_hours ago without an answer yet.

    fetched, a stream too (ticker, at, ok, sector, market_cap), brings answers: one that failed keeps what was known,
    else Unknown, and renews the age, as refresh_sectors() does. Times are the rows' own, so a replay gives the same.
    State is kept by ticker in the query's checkpoint, survives restarts, and goes forget_hours after its last use.
    Rows count in the order of arrival, those of one batch by `at`, answers before requests; rows without a ticker or
    time, and rows later than the watermark, are left out.
    """
    r = requests.select("ticker", "at", F.lit(False).alias("answer"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("double").alias("market_cap"))
    f = fetched.select("ticker", "at", F.lit(True).alias("answer"), F.coalesce("ok", F.lit(False)).alias("ok"), "sector", F.col("market_cap").cast("double").alias("market_cap"))
    rows = r.unionByName(f).where("ticker is not null and at is not null").withWatermark("at", late)
    most, again, forget = (int(h * HOUR) for h in (max_hours, retry_hours, forget_hours))

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        asked, got, sector, cap = state.get if state.exists else (None, None, None, None)
        used = max(asked or 0, got or 0)
        for batch in batches:
            out = []
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            for _, row in batch.assign(us=micros).sort_values(["us", "answer"], ascending=[True, False], kind="stable").iterrows():
                at = int(row["us"])
                used = max(used, at)
                if row["answer"]:
                    if got is not None and at < got:
                        continue  # an answer older than the one at hand
                    if row["ok"]:
                        sector, cap = row["sector"] or UNKNOWN, None if pd.isna(row["market_cap"]) else float(row["market_cap"])
                    else:
                        sector = sector or UNKNOWN
                    got = at
                elif got is not None and at - got <= most:
                    out.append((key[0], row["at"], "cached", sector, cap))
                elif asked is not None and (got is None or got < asked) and at - asked <= again:
                    out.append((key[0], row["at"], "pending", None, None))
                else:
                    asked = at
                    out.append((key[0], row["at"], "ask", None, None))
            if out:
                yield pd.DataFrame(out, columns=["ticker", "at", "status", "sector", "market_cap"])
        state.update((asked, got, sector, cap))
        state.setTimeoutTimestamp(max((used + forget) // 1000, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("ticker").applyInPandasWithState(step, ANSWER, STATE, "append", "EventTimeTimeout")
