"""An append-only journal of scans, signals, fills and exits: idempotent appends, upserts, delays, scan days.

Events have sequence, event_id, event_type, recorded_at and a JSON payload.  Unknown amounts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DELAY_SECONDS = 900


def event_id(*parts: Column) -> Column:
    """A stable identity: the hash of the parts."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


def append(existing: DataFrame, incoming: DataFrame, key: str = "event_id", content: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts): a known key with equal content is nothing new, with other content a conflict.

    Of several incoming rows with one key the one with the least content is the first observation.
    """
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), content).alias("r")).select("r.*")
    fresh = first.join(existing.select(key), key, "left_anti")
    old = existing.select(F.col(key), F.col(content).alias("recorded"))
    conflicts = incoming.join(old, key).where(~F.col(content).eqNullSafe(F.col("recorded"))).select(key, "recorded", F.col(content).alias("offered"))
    return fresh, conflicts


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; of equal versions the incoming one."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    newest = F.max_by(F.struct(*existing.columns), F.struct(version, "__new"))
    return rows.groupBy(key).agg(newest.alias("__row")).select("__row.*")


def recording_delay(recorded: Column, happened: Column, limit: int = MAX_DELAY_SECONDS) -> Column:
    """EARLY, LATE or ON_TIME by the seconds between an event and its record."""
    lag = F.timestamp_diff("SECOND", happened, recorded)
    return F.when(lag < 0, "EARLY").when(lag > limit, "LATE").when(lag.isNotNull(), "ON_TIME")


def scan_days(scans: DataFrame) -> DataFrame:
    """(market_date, scans, status) from (market_date, qualified): zero, mixed, reported or unknown counts."""
    q = F.col("qualified")
    state = (
        F.when(F.bool_or(q.isNull()), "COUNT_UNAVAILABLE")
        .when(F.bool_and(q == 0), "ZERO_SIGNALS_IN_ALL_RECORDED_SCANS")
        .when(F.bool_or(q == 0), "MIXED_ZERO_AND_NONZERO_SCANS")
        .otherwise("SIGNALS_REPORTED")
    )
    return scans.groupBy("market_date").agg(F.count("*").alias("scans"), state.alias("status"))


def build(scans: DataFrame, results: DataFrame, fingerprint: str) -> DataFrame:
    """(event_id, event_type, recorded_at, payload) of all scans, those without results too, and of each signal's first observation.

    scans: scan_id, market_date, recorded_at; results: scan_id, place (their order in a scan), ticker, strategy_id, signal_time, held, selected and
    any further columns, which go into the payload.  A held position, or a strategy that is no swing strategy, is no signal.
    A signal is the same if ticker, strategy, time and the parameters' fingerprint are.
    """
    c = F.col
    counts = results.groupBy("scan_id").agg(F.count("*").alias("qualified_signals"), F.count_if("selected").alias("selected"))
    seen = scans.join(counts, "scan_id", "left").na.fill(0, ["qualified_signals", "selected"])
    day = F.date_format("market_date", "yyyy-MM-dd").alias("market_date")
    scanned = seen.select(F.concat(F.lit("scan:"), event_id(c("scan_id"))).alias("event_id"), F.lit("SCAN").alias("event_type"), "recorded_at", F.to_json(F.struct(day, "qualified_signals", "selected")).alias("payload"))
    time = F.date_format("signal_time", "yyyy-MM-dd'T'HH:mm:ss")
    identity = F.concat(F.lit("signal:"), F.sha2(F.concat_ws("|", "ticker", "strategy_id", time, F.lit(fingerprint)), 256))
    rest = [x for x in results.columns if x not in ("scan_id", "place", "held", "signal_time")]
    payload = F.to_json(F.struct(*rest, time.alias("signal_time"), F.lit(fingerprint).alias("parameter_fingerprint")))
    rows = results.where(~c("held") & c("strategy_id").startswith("SWING_")).join(scans.select("scan_id", "recorded_at"), "scan_id")
    rows = rows.select(identity.alias("event_id"), "recorded_at", payload.alias("payload"), F.struct("recorded_at", "place").alias("__at"))
    first = rows.groupBy("event_id").agg(F.min_by(F.struct("recorded_at", "payload"), "__at").alias("r"))
    return scanned.unionByName(first.select("event_id", F.lit("SIGNAL").alias("event_type"), "r.recorded_at", "r.payload"))
