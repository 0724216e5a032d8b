"""Point-in-time lookups: rows have a valid date and a time since when they are known.

Decision points (with asof and session) may be many.  Lookups on both times merge points and revisions in order of
time, with the valid dates of one key as state; no table is held in one place.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(points: DataFrame, feed: DataFrame, valid: str, on: str = "ticker", tie: str | None = None, every: bool = False) -> DataFrame:
    """For each point (point_id, `on`, asof, session) the feed row with the latest `valid` date up to session, in its newest revision known by asof.

    With `every`, the newest revisions of all such dates.  Points and revisions are one sequence by time for each key
    and year, which a task reads once in order: it keeps the newest revision of each valid date seen so far, and
    answers a point from them by bisection.  So what a task holds is a key's valid dates and not its revisions or
    points, a point meets only rows that it gives, and a key with many points is spread over its years.  A revision
    goes to each year in which it is still the newest of its date.  Points without a known row give none.
    """
    c = F.col
    order = [*dict.fromkeys(["known_at", *([tie] if tie else [])])]
    next_known = F.lead("known_at").over(Window.partitionBy(on, valid).orderBy(*order))
    last = points.agg(F.max(F.year("asof")).alias("__last"))
    held = feed.where(c(valid).isNotNull() & c("known_at").isNotNull()).withColumn("__until", next_known).join(last, F.lit(True))
    until = F.least(F.coalesce(F.year("__until"), c("__last")), c("__last"))
    held = held.where(F.year("known_at") <= until).withColumn("__slice", F.explode(F.sequence(F.year("known_at"), until)))
    row = F.struct(*feed.columns)
    micros = lambda name: F.unix_micros(c(name).cast("timestamp"))
    rows = held.select(
        c(on).alias("__on"), "__slice", micros("known_at").alias("__at"), F.lit(0).alias("__kind"), (c(tie) if tie else F.lit(0)).alias("__tie"), micros(valid).alias("__valid"), row.alias("__row"),
        F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast(points.schema["asof"].dataType).alias("asof"), F.lit(None).cast(points.schema["session"].dataType).alias("session"),
    )
    asked = points.where(c("asof").isNotNull() & c("session").isNotNull()).select(
        c(on).alias("__on"), F.year("asof").alias("__slice"), micros("asof").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["__tie"].dataType).alias("__tie"), micros("session").alias("__valid"),
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "point_id", "asof", "session",
    )
    both = rows.unionByName(asked).where("__on is not null")
    both = both.repartition("__on", "__slice").sortWithinPartitions("__on", "__slice", "__at", "__kind", "__tie")
    schema = T.StructType([both.schema[n] for n in ("point_id", "asof", "session", "__row")])
    return both.mapInArrow(_merge(every), schema).select("point_id", "asof", "session", "__row.*")


def _merge(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The merge of one task: batches in order in, one batch of answers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dates, newest, kept = None, [], {}, None  # newest: valid date -> place in `kept`, the rows that state refers to
        for batch in batches:
            rows = batch.column("__row") if kept is None else pa.concat_arrays([kept, batch.column("__row")])
            base, asked, found = len(rows) - batch.num_rows, [], []
            columns = (batch.column(n).to_pylist() for n in ("__on", "__slice", "__kind", "__valid"))
            for k, (on, part, kind, valid) in enumerate(zip(*columns)):
                if (on, part) != key:
                    key, dates, newest = (on, part), [], {}
                if kind == 0:
                    if valid not in newest:
                        insort(dates, valid)
                    newest[valid] = base + k
                else:
                    upto = bisect_right(dates, valid)
                    chosen = dates[:upto] if every else dates[max(upto - 1, 0) : upto]
                    asked += [k] * len(chosen)
                    found += [newest[d] for d in chosen]
            if asked:
                at = pa.array(asked)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in ("point_id", "asof", "session")), rows.take(pa.array(found))], ["point_id", "asof", "session", "__row"])
            kept = rows.take(pa.array([newest[d] for d in dates], pa.int64()))
            newest = {d: k for k, d in enumerate(dates)}

    return run


def latest_known(points: DataFrame, feed: DataFrame, keys: list[str], valid: str, on: str = "ticker", tie: str | None = None) -> DataFrame:
    """For each point (point_id, `on`, asof, session): of feed rows known by asof and valid-dated up to session, the newest revision of each of `keys`.

    Where `keys` are the valid date (and `on`), this is `merged` with all dates.  Other keys turn revisions into
    intervals of knowledge and join on `on`.
    """
    if {*keys, on} == {valid, on}:
        return merged(points, feed, valid, on, tie, every=True)
    w = Window.partitionBy(*dict.fromkeys([on, *keys])).orderBy("known_at", *([tie] if tie else []))
    held = feed.withColumn("__until", F.lead("known_at").over(w))
    known = (F.col("known_at") <= F.col("asof")) & (F.col("__until").isNull() | (F.col("asof") < F.col("__until")))
    return points.select("point_id", on, "asof", "session").join(held, on).where(known & (F.col(valid) <= F.col("session"))).select("point_id", "asof", "session", *feed.columns)


def valid_interval(points: DataFrame, feed: DataFrame, tie: str | None = None) -> DataFrame:
    """For each point the latest effective row of its ticker, if it hasn't expired; revisions are chosen before validity is tested."""
    return merged(points, feed, "effective_date", tie=tie).where(F.col("valid_until") >= F.col("session"))


def index_history(points: DataFrame, feed: DataFrame, calendar: DataFrame, bars: int, tie: str | None = None) -> DataFrame:
    """(point_id, session, close): the last `bars` sessions of the calendar up to each point's, as known at its asof; null where nothing was.

    points: point_id, index, asof, session; feed: index, session, close, known_at; calendar: session.  A point asks for
    its sessions by ordinal; what is asked and the revisions of one (index, session) are one sequence by time, in which
    the last revision before a question answers it.
    """
    c = F.col
    days = calendar.select("session").distinct().withColumn("__k", F.row_number().over(Window.orderBy("session")))  # one small row a session
    dated = points.withColumnRenamed("session", "__upto").join(days.select(c("session").alias("__upto"), "__k"), "__upto")
    wanted = dated.select("point_id", "index", "asof", F.explode(F.sequence(F.greatest(c("__k") - (bars - 1), F.lit(1)), c("__k"))).alias("__k")).join(days, "__k")
    kind = points.schema["point_id"].dataType
    rows = feed.select("index", "session", "close", c("known_at").alias("__at"), F.lit(0).alias("__kind"), (c(tie) if tie else F.lit(0)).alias("__tie"), F.lit(None).cast(kind).alias("point_id"))
    asked = wanted.select("index", "session", F.lit(None).cast("double").alias("close"), c("asof").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["__tie"].dataType).alias("__tie"), "point_id")
    order = Window.partitionBy("index", "session").orderBy("__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(asked).withColumn("close", F.last("close", ignorenulls=True).over(order)).where("__kind = 1").select("point_id", "session", "close")


def next_events(points: DataFrame, events: DataFrame, sessions: DataFrame, within: int = 5, event: str | None = None) -> DataFrame:
    """(point_id, event_date, sessions_to_event): for each point the nearest event at most `within` sessions ahead of its session, as known at its asof.

    points: point_id, ticker, asof, session; events: ticker, event_date, known_at and, with `event`, the event's identity, of
    which a later row reschedules it: an old date holds until the next one is known.  Distances are in the sessions' order;
    an event on no session, like a point on none, is not found.  An event unfolds into the within + 1 sessions that it is
    near to, and meets points on equal ticker and session; the rest are filters.  Points without an event give no row.
    """
    c = F.col
    days = sessions.select("session").distinct().withColumn("__k", F.row_number().over(Window.orderBy("session")))  # one small row a session
    until = F.lead("known_at").over(Window.partitionBy("ticker", event).orderBy("known_at", "event_date")) if event else F.lit(None).cast("timestamp")
    dated = events.withColumn("__until", until).join(days.select(c("session").alias("event_date"), c("__k").alias("__at")), "event_date")
    near = dated.select("ticker", "event_date", "known_at", "__until", "__at", F.explode(F.sequence(c("__at") - within, c("__at"))).alias("__k"))
    asked = points.select("point_id", "ticker", "asof", "session").join(days, "session")
    known = (c("known_at") <= c("asof")) & (c("__until").isNull() | (c("asof") < c("__until")))
    found = asked.join(near, ["ticker", "__k"]).where(known).groupBy("point_id").agg(F.min(F.struct((c("__at") - c("__k")).alias("sessions_to_event"), "event_date")).alias("x"))
    return found.select("point_id", "x.event_date", "x.sessions_to_event")


def members_as_of(points: DataFrame, events: DataFrame) -> DataFrame:
    """(point_id, ticker) of tickers whose last action by (effective_date, known_at), with both times reached, is ADD.

    points: point_id, asof, session.  A ticker's actions are one array in one row, the last first.  The row unfolds
    into the months from its first action on, which points join by the month of their earlier time; so a
    point meets a ticker once, which is what its result may hold, and not once an action.
    """
    month = lambda x: F.trunc(x.cast("date"), "month")
    acts = F.struct("effective_date", "known_at", "action")
    first = month(F.least(F.col("known_at").cast("timestamp"), F.col("effective_date").cast("timestamp")))
    tickers = events.groupBy("ticker").agg(F.sort_array(F.collect_list(acts), asc=False).alias("acts"), F.min(first).alias("__from"))
    placed = points.select("point_id", "asof", "session", month(F.least(F.col("asof").cast("timestamp"), F.col("session").cast("timestamp"))).alias("__month"))
    last = placed.agg(F.max("__month").alias("__to"))
    spine = tickers.join(last, F.lit(True)).where("__from <= __to").select("ticker", "acts", F.explode(F.sequence("__from", "__to", F.expr("interval 1 month"))).alias("__month"))
    seen = placed.join(spine, "__month")
    reached = F.filter("acts", lambda e: (e["known_at"] <= F.col("asof")) & (e["effective_date"] <= F.col("session")))
    return seen.where(F.get(reached, F.lit(0))["action"] == "ADD").select("point_id", "ticker")


def snapshot_intervals(snapshots: DataFrame) -> DataFrame:
    """(ticker, start, end) of runs of adjacent snapshots (session, ticker) that hold a ticker: end is the first one without it, null if none is.

    Repeated rows of a snapshot count once.  The order of snapshots is one small row each.
    """
    order = snapshots.select("session").distinct()
    order = order.withColumns({"ord": F.row_number().over(Window.orderBy("session")), "next": F.lead("session").over(Window.orderBy("session"))})
    rows = snapshots.select("session", "ticker").distinct().join(order, "session")
    island = F.col("ord") - F.row_number().over(Window.partitionBy("ticker").orderBy("ord"))
    runs = rows.withColumn("__run", island).groupBy("ticker", "__run").agg(F.min("session").alias("start"), F.max_by("next", "ord").alias("end"))
    return runs.select("ticker", "start", "end")


def members_on(sessions: DataFrame, intervals: DataFrame) -> DataFrame:
    """(session, ticker) of half-open membership intervals [start, end); a null end is open.

    An interval unfolds into the months that it touches and sessions join on their month first, so
    that the range condition only filters rows of one month.
    """
    last = sessions.agg(F.max("session").alias("__last"))
    month = F.trunc(F.col("session").cast("date"), "month")
    spans = intervals.join(last, F.lit(True)).withColumn("__to", F.coalesce("end", "__last")).where(F.col("start") <= F.col("__to"))
    cells = spans.withColumn("__month", F.explode(F.sequence(F.trunc(F.col("start").cast("date"), "month"), F.trunc(F.col("__to").cast("date"), "month"), F.expr("interval 1 month"))))
    hit = (F.col("start") <= F.col("session")) & (F.col("end").isNull() | (F.col("session") < F.col("end")))
    return sessions.select("session", month.alias("__month")).join(cells, "__month").where(hit).select("session", "ticker").distinct()


def overlapping(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of their ticker has ended."""
    w = Window.partitionBy("ticker").orderBy("start", F.coalesce("end", F.lit("9999-12-31").cast("timestamp")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.coalesce("end", F.lit("9999-12-31").cast("timestamp"))).over(before)
    return intervals.withColumn("__until", until).where(F.col("__until") > F.col("start")).drop("__until")


def carried(spine: DataFrame, value: str, *by: str) -> Column:
    """The last value at or before each session, per group."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("session").rowsBetween(Window.unboundedPreceding, 0))


#: Rules of evidence feeds: name -> a condition that a bad row meets.
FEED_RULES = {
    "missing_time": "published_at IS NULL OR ingested_at IS NULL",
    "ingested_before_published": "ingested_at < published_at",
    "empty_source": "trim(coalesce(source, '')) = ''",
}
INTERVAL_RULES = {"expired_before_effective": "valid_until < effective_date"}
SURVEILLANCE_RULES = {"unknown_state": "state IS NULL OR state NOT IN ('CLEAR', 'ASM', 'GSM', 'BOTH', 'UNKNOWN')"}
DELIVERY_RULES = {"bad_quantities": "total_qty <= 0 OR delivery_qty < 0 OR delivery_qty > total_qty OR turnover < 0"}


def violations(rows: DataFrame, rules: dict[str, str], key: list[str] | None = None) -> DataFrame:
    """rows with `violations`, the names of all rules that each breaks; duplicates of `key` break `duplicate`."""
    found = [F.when(F.expr(condition), F.lit(name)) for name, condition in rules.items()]
    if key:
        found.append(F.when(F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1, F.lit("duplicate")))
    return rows.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))
