"""Sources and sinks: bars, vendor candles, feeds, journals, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "ticker string, session date, open double, high double, low double, close double, volume double"
FEEDS = {
    "indices": "index string, session date, close double",
    "sectors": "ticker string, effective_date date, valid_until date, sector_index string",
    "surveillance": "ticker string, effective_date date, valid_until date, state string",
    "delivery": "ticker string, session date, delivery_qty double, total_qty double, turnover double",
    "earnings": "ticker string, period_end date, announced_at timestamp, expected_at timestamp, expectation_ingested_at timestamp, actual_eps double, expected_eps double, expectation_kind string",
    "fundamentals": "ticker string, period_end date, eps_growth double, revenue_growth double, guidance_raised string",
    "flows": "ticker string, session date, fii_net_inr double, dii_net_inr double",
}
TIMING = "published_at timestamp, ingested_at timestamp, source string"


def bars(spark: SparkSession, path: str, tickers: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    """Daily bars; rows without any price are dropped, tickers are pushed to the scan."""
    reader = spark.read if kind == "parquet" else spark.read.schema(BARS).option("header", True)
    rows = reader.format(kind).load(path)
    rows = rows.where(F.col("ticker").isin(tickers)) if tickers else rows
    return rows.na.drop("all", subset=["open", "high", "low", "close"])


def vendor_candles(payloads: DataFrame, zone: str = "Asia/Kolkata") -> tuple[DataFrame, DataFrame]:
    """(bars, rejected) from (ticker, body): {"s": "ok", "candles": [[epoch, o, h, l, c, v], ...]}."""
    p = payloads.withColumn("p", F.from_json("body", "struct<s:string,candles:array<array<double>>>"))
    good = F.coalesce((F.col("p.s") == "ok") & (F.size("p.candles") > 0), F.lit(False))
    rows = p.where(good).select("ticker", F.explode("p.candles").alias("k"))
    names = ("open", "high", "low", "close", "volume")
    session = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.col("k")[0]), zone))
    return rows.select("ticker", session.alias("session"), *(F.col("k")[i + 1].alias(n) for i, n in enumerate(names))), p.where(~good).select("ticker", "body")


def fill_missing(primary: DataFrame, secondary: DataFrame, key: str = "ticker") -> DataFrame:
    """primary, and the rows of secondary whose key primary lacks altogether."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A typed evidence feed; `known_at` is the time of ingestion."""
    rows = spark.read.schema(f"{FEEDS[kind]}, {TIMING}").option("header", True).csv(path)
    plain = F.regexp_replace(F.upper(F.trim("ticker")), r"\.NS$", "") if "ticker" in rows.columns else None
    return (rows.withColumn("ticker", plain) if plain is not None else rows).withColumn("known_at", F.col("ingested_at"))


def journal_page(journal: DataFrame, after: int, limit: int) -> DataFrame:
    return journal.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def trades(log: DataFrame, ticker: str | None = None, outcome: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest trades first, filtered, by pages."""
    for name, value in (("ticker", ticker), ("outcome", outcome)):
        log = log.where(F.col(name) == value) if value else log
    return log.orderBy(F.desc("closed_at"), F.desc("trade_id")).offset(offset).limit(limit)


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: the report with the latest `end`, and how many files could not be read."""
    rows = spark.read.schema("end string, status string, _corrupt_record string").option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    good = F.col("end").isNotNull()
    return rows.agg(F.max_by(F.struct("path", "end", "status"), F.when(good, F.struct("end", "path"))).alias("latest"), F.count_if(~good).alias("unreadable"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: an order-free digest of the table and its number of rows.

    The digest is two sums of row hashes with different seeds, so that repeated rows count as often as they occur.
    """
    columns = sorted(df.columns)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("string")
    return df.agg(F.coalesce(F.concat_ws(":", total(1), total(2)), F.lit("")).alias("digest"), F.count("*").alias("rows"))


def membership(spark: SparkSession, path: str, suffix: str = ".NS") -> DataFrame:
    """Membership intervals (ticker, start, end) of a CSV file; symbols get the exchange's suffix if they lack it."""
    rows = spark.read.schema("ticker string, start date, end date").option("header", True).csv(path)
    plain = F.upper(F.trim("ticker"))
    return rows.withColumn("ticker", F.when(plain.endswith(suffix), plain).otherwise(F.concat(plain, F.lit(suffix))))


def portfolio_events(spark: SparkSession, path: str, least: float = 0.55) -> DataFrame:
    """portfolio_log of a file."""
    return portfolio_log(spark.read.text(path), least)


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text, for CSV sinks."""
    return df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema))


def long_bars(wide: DataFrame, separator: str = "|", date: str = "session") -> DataFrame:
    """Bars of a wide snapshot with columns such as `Close|AAA`: one row a ticker and session that has any field.

    Fields are named in lower case; a ticker without one of them has nulls there.
    """
    named = [(c, *c.split(separator, 1)) for c in wide.columns if separator in c]
    fields, tickers = list(dict.fromkeys(f for _, f, _ in named)), list(dict.fromkeys(t for _, _, t in named))
    place = {(f, t): c for c, f, t in named}
    cell = lambda f, t: F.col(f"`{place[f, t]}`").cast("double") if (f, t) in place else F.lit(None).cast("double")
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("ticker"), *(cell(f, t).alias(f.lower()) for f in fields)) for t in tickers)))
    return wide.select(date, rows.alias("r")).select("r.ticker", date, *(f"r.{f.lower()}" for f in fields)).dropna("all", subset=[f.lower() for f in fields])


def portfolio_log(lines: DataFrame, least: float = 0.55) -> DataFrame:
    """(ts, size, mean_prob_win, tickers) of the portfolios in a log of JSON lines (value) that hold something at `least` or more.

    Lines that aren't JSON objects, or lack the event, are passed over.
    """
    fields = F.from_json("value", "event string, ts string, size bigint, mean_prob_win double, tickers array<string>", {"mode": "PERMISSIVE"})
    rows = lines.select(fields.alias("r")).select("r.*").where("event = 'portfolio_built'")
    return rows.where((F.col("size") > 0) & (F.col("mean_prob_win") >= least)).select("ts", "size", "mean_prob_win", "tickers")


def memberships(spark: SparkSession, path: str, suffix: str = ".NS") -> DataFrame:
    """membership under its other name."""
    return membership(spark, path, suffix)
