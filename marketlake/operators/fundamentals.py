"""Point-in-time fundamentals: facts out of nested documents, two-stage dedup, insert-if-absent, reads as of a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.functions.numeric import half_even

KEY = ("ticker", "metric", "fiscal_year", "fiscal_period", "form_type")
#: Characters of a document that tell its range from others'.
RANGE_CHARS = 256
#: Members of an observation that facts() reads, with their types.
OBSERVATION = {"val": "double", "fy": "int", "fp": "string", "start": "string", "end": "string", "filed": "string", "form": "string"}

# Metrics and the taxonomy tags that report them, in order of preference.
METRIC_TAGS = {
    "Revenues": (
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet", "SalesRevenueServicesNet",
    ),
    "CostOfRevenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices"),
    "GrossProfit": ("GrossProfit",),
    "OperatingIncomeLoss": ("OperatingIncomeLoss",),
    "OperatingExpenses": ("CostsAndExpenses", "OperatingExpenses"),
    "SellingGeneralAndAdministrativeExpense": ("SellingGeneralAndAdministrativeExpense",),
    "ResearchAndDevelopmentExpense": ("ResearchAndDevelopmentExpense",),
    "NetIncomeLoss": ("NetIncomeLoss", "ProfitLoss"),
    "NetIncomeLossAvailableToCommonStockholdersBasic": ("NetIncomeLossAvailableToCommonStockholdersBasic",),
    "InterestExpense": ("InterestExpense", "InterestExpenseDebt", "InterestIncomeExpenseNet"),
    "IncomeTaxExpenseBenefit": ("IncomeTaxExpenseBenefit",),
    "EarningsPerShareBasic": ("EarningsPerShareBasic",),
    "EarningsPerShareDiluted": ("EarningsPerShareDiluted",),
    "CommonStockSharesOutstanding": ("CommonStockSharesOutstanding",),
    "WeightedAverageNumberOfSharesOutstandingBasic": ("WeightedAverageNumberOfSharesOutstandingBasic",),
    "WeightedAverageNumberOfDilutedSharesOutstanding": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
    "CommonStockDividendsPerShareDeclared": ("CommonStockDividendsPerShareDeclared",),
    "Assets": ("Assets",),
    "AssetsCurrent": ("AssetsCurrent",),
    "Liabilities": ("Liabilities",),
    "LiabilitiesCurrent": ("LiabilitiesCurrent",),
    "LongTermDebtNoncurrent": ("LongTermDebtNoncurrent",),
    "LongTermDebtCurrent": ("LongTermDebtCurrent",),
    "DebtCurrent": ("DebtCurrent",),
    "StockholdersEquity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "RetainedEarningsAccumulatedDeficit": ("RetainedEarningsAccumulatedDeficit",),
    "CashAndCashEquivalentsAtCarryingValue": (
        "CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalentsAtCarryingValueIncludingDiscontinuedOperations",
    ),
    "ShortTermInvestments": ("ShortTermInvestments",),
    "InventoryNet": ("InventoryNet",),
    "AccountsReceivableNetCurrent": ("AccountsReceivableNetCurrent",),
    "AccountsPayableCurrent": ("AccountsPayableCurrent",),
    "PropertyPlantAndEquipmentNet": ("PropertyPlantAndEquipmentNet",),
    "Goodwill": ("Goodwill",),
    "IntangibleAssetsNetExcludingGoodwill": ("IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"),
    "DepreciationDepletionAndAmortization": (
        "DepreciationDepletionAndAmortization", "Depreciation", "DepreciationAmortizationAndAccretionNet",
    ),
    "NetCashProvidedByUsedInOperatingActivities": (
        "NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ),
    "NetCashProvidedByUsedInInvestingActivities": (
        "NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations",
    ),
    "NetCashProvidedByUsedInFinancingActivities": (
        "NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations",
    ),
    "PaymentsToAcquirePropertyPlantAndEquipment": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "PaymentsForRepurchaseOfCommonStock": ("PaymentsForRepurchaseOfCommonStock",),
    "PaymentsOfDividends": ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock"),
}


def tag_dimension(spark: SparkSession) -> DataFrame:
    """(metric, tag, metric_nth, tag_nth)"""
    rows = [(m, t, i, j) for i, (m, tags) in enumerate(METRIC_TAGS.items()) for j, t in enumerate(tags)]
    return spark.createDataFrame(rows, "metric string, source_tag string, metric_nth int, tag_nth int")


def date_of(col: Column) -> Column:
    return F.try_to_date(col) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(col))


def tags(documents: DataFrame, taxonomy: str | None = "us-gaap") -> DataFrame:
    """(ticker, cik, taxonomy, source_tag, units, unit_names) of documents (ticker, cik, body: JSON), of all taxonomies if None.

    Documents are read as VARIANT, so no schema has to fit: units maps a unit to whatever the document says there, and
    unit_names are the units in the document's order (variants sort their keys). Tags without units do not come; bodies
    that are null, no JSON or name a key twice have no tags.
    """
    parsed = documents.select("ticker", "cik", "body", F.try_parse_json("body").alias("_v"))
    if taxonomy is None:
        parsed = parsed.select("ticker", "cik", "body", F.explode(F.try_variant_get("_v", "$.facts", "map<string, variant>")).alias("taxonomy", "_t"))
        found = F.try_variant_get("_t", "$", "map<string, variant>")
    else:
        parsed = parsed.withColumn("taxonomy", F.lit(taxonomy))
        found = F.try_variant_get("_v", f"$.facts['{taxonomy}']", "map<string, variant>")
    by_tag = parsed.select("ticker", "cik", "body", "taxonomy", F.explode(found).alias("source_tag", "_tag"))
    by_tag = by_tag.withColumn("units", F.try_variant_get("_tag", "$.units", "map<string, variant>")).where(F.size("units") > 0)
    here = F.concat(F.lit("$.facts['"), F.col("taxonomy"), F.lit("']['"), F.col("source_tag"), F.lit("'].units"))
    # a second look at the text only where there is an order to find
    names = F.when(F.size("units") > 1, F.json_object_keys(F.call_function("get_json_object", F.col("body"), here)))
    return by_tag.select("ticker", "cik", "taxonomy", "source_tag", "units", F.coalesce(names, F.map_keys("units")).alias("unit_names"))


def observations(by_tag: DataFrame) -> DataFrame:
    """tags(), with other columns kept, to one row per observation: unit, its place unit_nth, obs_nth, and the
    observation as a VARIANT. A unit that holds no list has none, and its siblings keep theirs."""
    by_unit = by_tag.select("*", F.posexplode("unit_names").alias("unit_nth", "unit"))
    listed = F.try_variant_get(F.try_element_at("units", F.col("unit")), "$", "array<variant>")
    return by_unit.select("*", F.posexplode(listed).alias("obs_nth", "observation")).drop("units", "unit_names")


def facts(documents: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """documents (ticker, cik, body: JSON) to one row per observation of a known tag, with its place as `nth`. Members of
    an observation that are missing or of another type are null."""
    known = tags(documents, taxonomy).join(F.broadcast(tag_dimension(documents.sparkSession)), "source_tag")
    seen = observations(known)
    o = {name: F.try_variant_get("observation", f"$.{name}", of) for name, of in OBSERVATION.items()}
    return seen.select(
        "ticker", "cik", "metric", "source_tag", o["val"].alias("value"), "unit", o["fy"].alias("fiscal_year"), o["fp"].alias("fiscal_period"),
        date_of(o["start"]).alias("period_start"), date_of(o["end"]).alias("period_end"), date_of(o["filed"]).alias("filed_date"), o["form"].alias("form_type"),
        F.struct("metric_nth", "tag_nth", "unit_nth", "obs_nth").alias("nth"),
    )


def complete(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["fiscal_year", "fiscal_period", "period_end", "filed_date", "form_type"])


def by_key(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows dealt over n tasks by KEY, so that aggregates by KEY need no other shuffle. Take n by the number of rows: a task's
    share then stays as it is while they grow. Without it Spark takes the session's number."""
    return rows.repartition(n, *KEY) if n else rows.repartition(*KEY)


def one_per_filing(rows: DataFrame) -> DataFrame:
    """Stage 1: per metric, period, form and filing date the fact whose length is nearest the period's; where any fact
    has no start, the one that ends last. Ties fall to the order of the document, `nth`."""
    key = ["ticker", "metric", "fiscal_year", "fiscal_period", "form_type", "filed_date"]
    with_start = F.min(F.col("period_start").isNotNull()).over(W.partitionBy(*key))
    usual = F.when(F.col("fiscal_period") == "FY", 365).otherwise(91)
    off = F.when(F.col("_all"), F.abs(F.datediff("period_end", "period_start") - usual))
    w = W.partitionBy(*key).orderBy(F.col("_off").asc(), F.col("period_end").desc(), F.col("nth").asc())
    return rows.withColumn("_all", with_start).withColumn("_off", off).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_all", "_off", "_n")


def first_filed(rows: DataFrame) -> DataFrame:
    """Stage 2: per key the earliest filing."""
    w = W.partitionBy(*KEY).orderBy("filed_date", "nth")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def earliest(rows: DataFrame) -> DataFrame:
    """first_filed(one_per_filing(rows)) without nth, of complete rows, as one aggregate by KEY: only facts of a key's first
    filing day can stay, so both picks of stage 1 are made among these. Where rows are dealt by KEY (by_key), no other
    shuffle follows; where a reader asks for some columns only, Spark prunes the picks and what they order by."""
    rest = [c for c in rows.columns if c not in (*KEY, "filed_date", "nth")]
    usual = F.when(F.col("fiscal_period") == "FY", 365).otherwise(91)
    off, last = F.abs(F.datediff("period_end", "period_start") - usual).alias("off"), (-F.unix_date("period_end")).alias("last")
    found = rows.groupBy(*KEY).agg(
        F.min("filed_date").alias("filed_date"), F.min(F.struct("filed_date", F.col("period_start").isNotNull().alias("all")))["all"].alias("_all"),
        F.min_by(F.struct(*rest), F.struct("filed_date", off, last, "nth")).alias("_near"), F.min_by(F.struct(*rest), F.struct("filed_date", last, "nth")).alias("_last"),
    )
    picked = found.withColumn("_row", F.when(F.col("_all"), F.col("_near")).otherwise(F.col("_last")))
    return picked.select(*[F.col(f"_row.{c}") if c in rest else c for c in rows.columns if c != "nth"])


def parse(documents: DataFrame) -> DataFrame:
    return earliest(by_key(complete(facts(documents))))


def absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key is not stored: what insert-if-absent appends."""
    return new.dropDuplicates(list(KEY)).join(stored.select(*KEY), list(KEY), "left_anti")


def _append(new: DataFrame, stored: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the absent rows of new; one pass over new, counted on the way, so the counts are those of what is written."""
    tried, kept = Observation(), Observation()
    fresh = absent(new.observe(tried, F.count(F.lit(1)).alias("n")), stored)
    write(fresh.observe(kept, F.count(F.lit(1)).alias("n")))
    return {"attempted": tried.get.get("n", 0), "inserted": kept.get.get("n", 0)}


def upsert(new: DataFrame, path: str) -> dict[str, int]:
    """Append absent rows to a Parquet table; how many were tried and inserted."""
    spark = new.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        stored = spark.createDataFrame([], new.schema)
    return _append(new, stored, lambda fresh: fresh.write.mode("append").parquet(path))


def by_buckets(new: DataFrame, name: str) -> DataFrame:
    """new, with the columns of a table, dealt over the table's buckets, so that dedup, join and insert need no other
    shuffle. Columns of the table that new lacks become null, others of new are left out."""
    spark = new.sparkSession
    have = {c.lower() for c in new.columns}
    fit = new.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.table(name).schema])
    n = [int(r["data_type"]) for r in spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()]
    return fit.repartition(n[0], *KEY) if n else fit


def insert_absent(new: DataFrame, name: str) -> dict[str, int]:
    """upsert() into a table bucketed by KEY (warehouse.create_tables): new rows are shuffled once, to the buckets they
    belong to, the stored side is read bucket by bucket without an exchange, and only touched buckets get a file."""
    stored = new.sparkSession.table(name)
    return _append(by_buckets(new, name), stored, lambda fresh: fresh.select(*stored.columns).write.insertInto(name))


def read_pit(stored: DataFrame, ticker: str | None = None, metrics: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Facts known by a day: nothing filed later."""
    out = stored
    if ticker:
        out = out.where(F.col("ticker") == ticker)
    if metrics:
        out = out.where(F.col("metric").isin(metrics))
    if as_of:
        out = out.where(F.col("filed_date") <= F.lit(as_of).cast("date"))
    return out


def latest_filed(stored: DataFrame) -> DataFrame:
    return stored.groupBy("ticker").agg(F.max("filed_date").alias("latest_filed"))


def to_ingest(companies: DataFrame, latest_known: DataFrame, latest_offered: DataFrame) -> DataFrame:
    """(ticker, cik, status): no_cik, up_to_date or ingest; where a date is unknown the company is ingested."""
    j = companies.join(latest_known, "ticker", "left").join(latest_offered, "ticker", "left")
    status = F.when(F.col("cik").isNull(), "no_cik").when(F.col("latest_offered") <= F.col("latest_filed"), "up_to_date").otherwise("ingest")
    return j.select("ticker", "cik", status.alias("status"))


def latest_offered(submissions: DataFrame) -> DataFrame:
    """(ticker, latest_offered) from submissions (ticker, body: JSON)."""
    dates = F.from_json("body", "struct<filings: struct<recent: struct<filingDate: array<string>>>>")["filings"]["recent"]["filingDate"]
    return submissions.select("ticker", F.array_max(F.transform(dates, date_of)).alias("latest_offered"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")


def duplicate_keys(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def star(stored: DataFrame, metrics: DataFrame, units: DataFrame, forms: DataFrame, tags: DataFrame) -> DataFrame:
    """Names for a fact table of ids: metric and tag are required, unit and form optional. Spark broadcasts what is small."""
    return stored.join(metrics, "metric_id").join(units, "unit_id", "left").join(forms, "form_type_id", "left").join(tags, "source_tag_id")


def in_order(facts: DataFrame, metric: str = "metric_id") -> DataFrame:
    """As readers get them: by the end of the period, then by metric."""
    return facts.orderBy(F.col("period_end").asc_nulls_last(), metric)


def with_ids(names: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """A dimension grown by the names it lacks, numbered on from its greatest id."""
    new = names.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    n = F.row_number().over(W.orderBy(column))
    return known.select("id", column).unionByName(new.crossJoin(F.broadcast(top)).select((F.col("_top") + n).alias("id"), column))


def mismatches(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts on both sides that differ in value (2 digits), unit or period end; nulls differ from all, also from nulls."""
    on = ["metric", "fiscal_year", "fiscal_period", "form_type"]
    side = lambda d, s: d.select("ticker", *on, *[F.col(c).alias(f"{c}_{s}") for c in ("value", "unit", "period_end", "source_tag")])
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    both = side(new, "new").join(side(stored, "db"), ["ticker", *on])
    c = F.col
    differs = ~same(half_even(c("value_new"), 2), half_even(c("value_db"), 2)) | ~same(c("unit_new"), c("unit_db")) | ~same(c("period_end_new"), c("period_end_db"))
    return both.where(differs)


def with_fundamentals(companies: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct (ticker, cik) of companies that have a cik and a fact."""
    return companies.where("cik is not null").join(stored, "ticker", "left_semi").select("ticker", "cik").distinct()


def cik_map(documents: DataFrame) -> DataFrame:
    """(ticker, cik) from the published map (body: JSON of {n: {ticker, cik_str}}); tickers in upper case. Of entries that
    share a ticker the last in the document counts; of documents that do, the one with the greatest body.

    A number that grows with the body stands for each document, so no entry carries its document: documents are dealt over
    ranges of how they begin, which the driver samples, and sorted inside these on the whole of it.
    """
    ranges = documents.where("body is not null").repartitionByRange(F.substring("body", 1, RANGE_CHARS)).sortWithinPartitions("body")
    ranked = ranges.select("body", F.monotonically_increasing_id().alias("rank")).repartition("rank")
    entries = F.map_values(F.from_json("body", "map<string, struct<ticker: string, cik_str: bigint>>"))
    rows = ranked.select("rank", F.posexplode(entries).alias("nth", "r")).select("rank", "nth", F.upper("r.ticker").alias("ticker"), "r.cik_str")
    return rows.groupBy("ticker").agg(F.max_by("cik_str", F.struct("rank", "nth")).cast("int").alias("cik"))


def with_cik(tickers: DataFrame, ciks: DataFrame) -> DataFrame:
    known = ciks.select(F.upper("ticker").alias("_t"), "cik")
    return tickers.join(known, F.upper("ticker") == F.col("_t"), "left").drop("_t")


def ingest(companies: DataFrame, stored: DataFrame, submissions: DataFrame, documents: DataFrame, only_new: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts to insert, one row for each company: ticker, status, attempted, inserted, error) of an ingest.

    companies: ticker, cik. submissions: ticker, body. documents: ticker, body, error; a null body without an error
    means that there are none. Statuses: no_cik, up_to_date (with only_new), no_facts, error, ok. A company whose offered
    or known date is not known is never skipped.
    """
    plan = to_ingest(companies, latest_filed(stored), latest_offered(submissions))
    plan = plan.withColumn("status", F.when((F.col("status") == "up_to_date") & ~F.lit(only_new), "ingest").otherwise(F.col("status")))
    got = plan.join(documents.select("ticker", "body", "error"), "ticker", "left")
    done = F.when(F.col("status") != "ingest", F.col("status")).when(F.col("error").isNotNull(), "error").when(F.col("body").isNull(), "no_facts").otherwise("ok")
    got = got.withColumn("status", done)
    rows = parse(got.where("status = 'ok'").select("ticker", "cik", "body"))
    new = absent(rows, stored)
    tried, kept = rows.groupBy("ticker").agg(F.count("*").alias("attempted")), new.groupBy("ticker").agg(F.count("*").alias("inserted"))
    report = got.select("ticker", "status", "error").join(tried, "ticker", "left").join(kept, "ticker", "left")
    counted = F.col("status").isin("ok", "up_to_date")
    return new, report.withColumns({c: F.when(counted, F.coalesce(c, F.lit(0))) for c in ("attempted", "inserted")})
