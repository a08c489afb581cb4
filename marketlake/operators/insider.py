"""Insider filings: the index out of parallel arrays, transactions out of ownership documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.numeric import flag_one, text_or_null, to_float

INDEX = (
    "struct<filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, primaryDocument: array<string>>,"
    " files: array<struct<name: string, filingTo: string>>>>"
)



def filing_index(submissions: DataFrame, since: str | None = None, form: str = "4") -> DataFrame:
    """(ticker, cik, accession_number, filing_date, document) of one form since a day; submissions: ticker, cik, body."""
    r = F.from_json("body", INDEX)["filings"]["recent"]
    rows = submissions.select("ticker", "cik", F.inline(F.arrays_zip(r["form"].alias("form"), r["accessionNumber"].alias("accession_number"), r["filingDate"].alias("filing_date"), r["primaryDocument"].alias("document"))))
    out = rows.where(F.col("form") == form).drop("form")
    return out.where(F.col("filing_date") >= since) if since else out


def older_shards(submissions: DataFrame, since: str | None = None) -> DataFrame:
    """(ticker, name) of older index files to fetch: only where the window starts before the recent part, and none that ends before it."""
    doc = F.from_json("body", INDEX)["filings"]
    rows = submissions.select("ticker", F.array_min(doc["recent"]["filingDate"]).alias("oldest"), F.inline(doc["files"]))
    if since is None:
        return rows.select("ticker", "name")
    return rows.where((F.lit(since) < F.col("oldest")) & (F.col("filingTo").isNull() | (F.col("filingTo") >= since))).select("ticker", "name")


def form_path(filings: DataFrame) -> DataFrame:
    """Adds `path`: cik, accession number without dashes, the document without a rendering prefix."""
    return filings.withColumn("path", F.concat_ws("/", F.col("cik").cast("string"), F.replace("accession_number", F.lit("-"), F.lit("")), F.element_at(F.split("document", "/"), -1)))


def transactions(documents: DataFrame) -> DataFrame:
    """documents (ticker, cik, accession_number, filing_date, body: XML) to one row per owner and transaction.

    Text stands in a `value` child or in the element itself; blank text is null, so is a number that is none. Only the
    text 1 makes a flag true. A document without owners has one without a name; a malformed one gives no rows.
    """
    leaf = "struct<_VALUE: string, value: string>"
    schema = (
        f"struct<reportingOwner: array<struct<reportingOwnerId: struct<rptOwnerName: {leaf}>, officerTitle: {leaf},"
        f" reportingOwnerRelationship: struct<officerTitle: {leaf}, isDirector: {leaf}, isOfficer: {leaf}, isTenPercentOwner: {leaf}>>>,"
        f" nonDerivativeTable: struct<nonDerivativeTransaction: array<struct<transactionDate: {leaf}, transactionCoding: struct<transactionCode: {leaf}>,"
        f" transactionAmounts: struct<transactionShares: {leaf}, transactionPricePerShare: {leaf}>,"
        f" postTransactionAmounts: struct<sharesOwnedFollowingTransaction: {leaf}>, ownershipNature: struct<directOrIndirectOwnership: {leaf}>>>>>"
    )
    text = lambda c: text_or_null(F.coalesce(c["value"], c["_VALUE"]))
    # the last mark is an end tag; only what follows it is searched
    whole = F.contains("body", F.lit("<")) & F.rlike(F.substring_index("body", "<", -1), F.lit(r"^/\s*\w+\s*>\s*$"))
    parsed = documents.where(whole).withColumn("d", F.from_xml("body", schema, {"mode": "PERMISSIVE"}))
    rows = parsed.select("ticker", "cik", "accession_number", "filing_date", F.col("d.reportingOwner").alias("owners"), F.posexplode("d.nonDerivativeTable.nonDerivativeTransaction").alias("transaction_index", "t"))
    rows = rows.select("*", F.explode_outer("owners").alias("o"))
    t, o, rel = F.col("t"), F.col("o"), F.col("o.reportingOwnerRelationship")
    return rows.select(
        "ticker", "cik", "accession_number", "filing_date", text(o["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        F.coalesce(text(rel["officerTitle"]), text(o["officerTitle"])).alias("insider_title"), flag_one(text(rel["isDirector"])).alias("is_director"),
        flag_one(text(rel["isOfficer"])).alias("is_officer"), flag_one(text(rel["isTenPercentOwner"])).alias("is_ten_pct_owner"),
        text(t["transactionDate"]).alias("transaction_date"), text(t["transactionCoding"]["transactionCode"]).alias("transaction_code"),
        to_float(text(t["transactionAmounts"]["transactionShares"])).alias("shares"), to_float(text(t["transactionAmounts"]["transactionPricePerShare"])).alias("price_per_share"),
        to_float(text(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"])).alias("shares_owned_after"),
        text(t["ownershipNature"]["directOrIndirectOwnership"]).alias("ownership_type"), "transaction_index",
    )


def run(submissions: DataFrame, documents: DataFrame, since: str | None = None) -> DataFrame:
    """Index, documents, transactions: submissions (ticker, cik, body); documents (path, body), of which a missing or
    malformed one costs its own filing and no other."""
    filings = form_path(filing_index(submissions, since))
    return transactions(filings.join(documents.where("body is not null"), "path").select("ticker", "cik", "accession_number", "filing_date", "body"))
