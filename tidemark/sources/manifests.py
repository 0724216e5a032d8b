"""Evidence feeds from a folder with a manifest: typed by kind, checked by declared rules in one pass, bad rows set aside with all their reasons.

A kind declares its columns with types, its key, and its rules as SQL conditions that a bad row meets.  Files are read as
text; each column is parsed strictly, and what can't be parsed, is missing or breaks a rule is named in `violations`.  All
kinds' conditions are expressions of one projection; only repeated keys need a shuffle, by the key.

Types: ticker (upper-cased, without its exchange's suffix), text, number (finite), day (a calendar date), instant (a time
with its zone), flag (true, false, 1, 0).  Blank counts as missing, and every column is required.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Kind(NamedTuple):
    columns: dict[str, str]
    key: tuple[str, ...]
    rules: dict[str, str]


#: The exchange's zone, in which an instant's day is taken.
ZONE = "Asia/Kolkata"
_TIMING = {"published_at": "instant", "ingested_at": "instant", "source": "text"}
_ORDER = {"ingested_before_published": "ingested_at < published_at"}


def _day(instant: str) -> str:
    return f"to_date(from_utc_timestamp(to_utc_timestamp({instant}, current_timezone()), '{ZONE}'))"


def _feed(columns: dict[str, str], key: tuple[str, ...], rules: dict[str, str], dated: str | None = None) -> Kind:
    late = {"published_before_its_day": f"{_day('published_at')} < {dated}"} if dated else {}
    return Kind(columns | _TIMING, key, _ORDER | rules | late)


KINDS = {
    "indices": _feed({"index": "text", "session": "day", "close": "number"}, ("index", "session"), {"nonpositive_close": "close <= 0"}, "session"),
    "sectors": _feed({"ticker": "ticker", "effective_date": "day", "valid_until": "day", "sector_index": "text"}, ("ticker", "effective_date"), {"expired_before_effective": "valid_until < effective_date"}),
    "surveillance": _feed(
        {"ticker": "ticker", "effective_date": "day", "valid_until": "day", "state": "text"}, ("ticker", "effective_date"),
        {"expired_before_effective": "valid_until < effective_date", "unknown_state": "state NOT IN ('CLEAR', 'ASM', 'GSM', 'BOTH', 'UNKNOWN')"},
    ),
    "earnings": _feed(
        {"ticker": "ticker", "period_end": "day", "announced_at": "instant", "expected_at": "instant", "expectation_ingested_at": "instant", "actual_eps": "number", "expected_eps": "number", "expectation_kind": "text"}, ("ticker", "period_end"),
        {
            "unknown_expectation": "expectation_kind NOT IN ('CONSENSUS', 'SEASONAL')",
            "expected_after_announcement": "expected_at >= announced_at",
            "expectation_ingested_before_made": "expectation_ingested_at < expected_at",
            "expectation_known_too_late": "expectation_ingested_at >= announced_at",
            "published_before_announcement": "published_at < announced_at",
            "announced_before_period_end": f"{_day('announced_at')} < period_end",
        }, "period_end",
    ),
    "fundamentals": _feed({"ticker": "ticker", "period_end": "day", "eps_growth": "number", "revenue_growth": "number", "guidance_raised": "flag"}, ("ticker", "period_end"), {}, "period_end"),
    "delivery": _feed(
        {"ticker": "ticker", "session": "day", "delivery_qty": "number", "total_qty": "number", "turnover": "number"}, ("ticker", "session"),
        {"bad_quantities": "total_qty <= 0 OR delivery_qty < 0 OR delivery_qty > total_qty OR turnover < 0"}, "session",
    ),
    "flows": _feed({"ticker": "ticker", "session": "day", "fii_net_inr": "number", "dii_net_inr": "number"}, ("ticker", "session"), {}, "session"),
    "calendar": Kind({"ticker": "ticker", "event_date": "day", "known_at": "instant"}, (), {}),
    "membership": Kind({"ticker": "ticker", "effective_date": "day", "action": "text", "known_at": "instant"}, ("ticker", "effective_date"), {"unknown_action": "upper(action) NOT IN ('ADD', 'REMOVE')"}),
}


def _parsed(name: str, kind: str) -> Column:
    raw = F.trim(F.col(name))
    return {
        "text": lambda: F.nullif(raw, F.lit("")),
        "ticker": lambda: F.nullif(F.regexp_replace(F.upper(raw), r"\.NS$", ""), F.lit("")),
        "number": lambda: F.when(~F.isnan(raw.try_cast("double")) & (F.abs(raw.try_cast("double")) < float("inf")), raw.try_cast("double")),
        "day": lambda: F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date")),
        "instant": lambda: F.when(raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), raw.try_cast("timestamp")),
        "flag": lambda: F.when(F.lower(raw).isin("true", "1"), True).when(F.lower(raw).isin("false", "0"), False),
    }[kind]()


def check(rows: DataFrame, kind: str) -> DataFrame:
    """rows, whose kind's columns are text, with those columns typed, `known_at`, and `violations`: the names of all that is wrong.

    A column that rows lack is missing in all of them.  Names: missing:COLUMN, bad_TYPE:COLUMN, the kind's rules, and
    conflicting_revision for rows of one key that were known at the same time.
    """
    spec = KINDS[kind]
    for name in spec.columns:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    raw = rows.withColumn("__raw", F.struct(*spec.columns))
    typed = raw.withColumns({n: _parsed(n, t) for n, t in spec.columns.items()})
    if "ingested_at" in spec.columns:
        typed = typed.withColumn("known_at", F.col("ingested_at"))
    found = []
    for name, of in spec.columns.items():
        blank = F.coalesce(F.trim(F.col(f"__raw.`{name}`")) == "", F.lit(True))
        found.append(F.when(blank, F.lit(f"missing:{name}")).when(F.col(name).isNull(), F.lit(f"missing:{name}" if of in ("text", "ticker") else f"bad_{of}:{name}")))
    found += [F.when(F.expr(condition), F.lit(rule)) for rule, condition in spec.rules.items()]
    if spec.key:
        same = [*spec.key, "known_at"]
        whole = F.lit(True)
        for name in same:
            whole = whole & F.col(name).isNotNull()
        found.append(F.when(whole & (F.count(F.lit(1)).over(Window.partitionBy(*same)) > 1), F.lit("conflicting_revision")))
    return typed.withColumn("violations", F.array_compact(F.array(*found))).drop("__raw")


class Feeds(NamedTuple):
    """Good rows by kind; bad ones as (kind, violations, row) with the row as JSON; the manifest's settings."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame
    settings: dict[str, object]


def load(spark: SparkSession, folder: str, kinds: tuple[str, ...] = tuple(KINDS)) -> Feeds:
    """The feeds of a folder: manifest.json (sector_universe, benchmark_index, vix_index, benchmark_ticker) and a CSV file or folder for each kind present."""
    settings = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    lacking = [n for n in ("sector_universe", "benchmark_index", "vix_index", "benchmark_ticker") if n not in settings]
    if lacking:
        raise ValueError(f"the manifest lacks {', '.join(lacking)}")
    tables, bad = {}, spark.createDataFrame([], "kind string, violations array<string>, row string")
    system = spark.sparkContext._jvm.org.apache.hadoop.fs
    for kind in kinds:
        place = system.Path(f"{folder}/{kind}.csv")
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            continue
        rows = check(spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{kind}.csv"), kind)
        good = F.size("violations") == 0
        tables[kind] = rows.where(good).drop("violations")
        bad = bad.unionByName(rows.where(~good).select(F.lit(kind).alias("kind"), "violations", F.to_json(F.struct(*KINDS[kind].columns)).alias("row")))
    return Feeds(tables, bad, settings)
