"""Structured Streaming forms of the stateful operators; each also takes a static DataFrame where its operators allow."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import alerts, fitting, journal
from tidemark.operators.indicators import SUPER_FACTOR, SUPER_PERIOD, Band
from tidemark.operators.market import ADX_RANGE, ADX_TREND, EXPANSION_ATR, PANIC, PANIC_EXIT, TREND_DOWN_BREADTH, TREND_UP_BREADTH


def tick_bars(ticks: DataFrame, every: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Bars of (ticker, ts, seq, price, qty) by event-time windows, tumbling or sliding; rows later than `late` are dropped."""
    order = F.struct("ts", "seq")
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", every, slide or every), "ticker")
    bars = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))
    return bars.select("ticker", F.col("window.start").alias("session"), "open", "high", "low", "close", "volume")


def activity_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a ticker's ticks with pauses under `gap`."""
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "ticker").agg(F.count("*").alias("ticks")).select("ticker", "session_window.start", "session_window.end", "ticks")


def alert_stream(candidates: DataFrame, least: float = 0.55, hours: float = 4.0, top: int = 5, late: str = "0 seconds") -> DataFrame:
    """alerts() over a stream: what a channel has sent within `hours` is its state, and each scan sends its best `top` at most.

    A channel's scans must arrive in order, up to those of one trigger.  A timer removes a channel's state once the watermark is
    past all that it remembers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "place", "key"], kind="stable")
        sent = json.loads(state.get[0]) if state.exists else {}
        chosen = []
        for at, scan in rows.groupby("ts", sort=True):
            chosen += alerts.send(sent, at.value // 1000, scan.index, zip(scan["key"], scan["probability"]), least, hours, top)
        if sent:
            state.update((json.dumps(sent),))
            state.setTimeoutTimestamp(max(max(sent.values()) // 1000 + int(hours * 3_600_000), state.getCurrentWatermarkMs()) + 1)
        yield rows.loc[chosen, ["channel", "ts", "key", "probability"]]

    # places of rows are their labels, so they must differ within a channel's batch
    def labelled(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole = [pd.concat(list(batches), ignore_index=True)] if not state.hasTimedOut else []
        return step(key, iter(whole), state)

    rows = candidates.withWatermark("ts", late)
    return rows.groupBy("channel").applyInPandasWithState(labelled, "channel string, ts timestamp, key string, probability double", "sent string", "append", GroupStateTimeout.EventTimeTimeout)


def regime_stream(metrics: DataFrame) -> DataFrame:
    """Regimes of (market, session, breadth, adx_median, atr_ratio) with the panic state kept by market.

    Sessions of one market must arrive in order; state is one flag and the last label.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        out = []
        for batch in batches:
            for r in batch.sort_values("session").itertuples():
                limit = PANIC_EXIT if last == "PANIC" else PANIC
                trend = "TREND_UP" if r.breadth >= TREND_UP_BREADTH else "TREND_DOWN" if r.breadth < TREND_DOWN_BREADTH else "RANGE"
                strong = r.adx_median >= ADX_TREND
                now = "PANIC" if r.breadth < limit else "EXPANSION" if strong and r.atr_ratio >= EXPANSION_ATR else "RANGE" if r.adx_median < ADX_RANGE else trend
                out.append((key[0], r.session, now, now in ("PANIC", last)))
                last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["market", "session", "regime", "confirmed"])

    return metrics.groupBy("market").applyInPandasWithState(step, "market string, session timestamp, regime string, confirmed boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def position_exits(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """The first bar after a position's opening that reaches its stop (first) or target, with gap-aware prices; joined to a static position table.

    A position exits once: over a stream a flag is kept for each position, and its bars must arrive in order.
    """
    c = F.col
    sign = F.when(c("direction") == "LONG", 1.0).otherwise(-1.0)
    worst, best = F.when(sign > 0, c("low")).otherwise(c("high")), F.when(sign > 0, c("high")).otherwise(c("low"))
    stopped, reached = (worst - c("stop")) * sign <= 0, (best - c("target")) * sign >= 0
    price = F.when(stopped, F.when((c("open") - c("stop")) * sign <= 0, c("open")).otherwise(c("stop"))).otherwise(F.when((c("open") - c("target")) * sign >= 0, c("open")).otherwise(c("target")))
    hits = bars.join(positions, "ticker").where((c("session") > c("opened")) & (stopped | reached))
    hits = hits.select("position_id", "ticker", "session", F.when(stopped, "STOP").otherwise("TARGET").alias("reason"), price.alias("price"))
    if not bars.isStreaming:
        first = hits.groupBy("position_id").agg(F.min(F.struct("session", "ticker", "reason", "price")).alias("x"))
        return first.select("position_id", "x.ticker", "x.session", "x.reason", "x.price")

    names = hits.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not state.exists:
            state.update((True,))
            yield rows.sort_values("session").head(1)[names]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema)
    return hits.groupBy("position_id").applyInPandasWithState(step, schema, "closed boolean", "append", GroupStateTimeout.NoTimeout)


def append_journal(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends events whose id is new; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(path)
            known.limit(0).count()
        except Exception as error:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = spark.createDataFrame([], batch.schema)
        fresh, _conflicts = journal.append(known, batch)
        fresh.select(*batch.columns).write.mode("append").parquet(path)

    return write


def indicator_stream(bars: DataFrame, span: int = 20, period: int = 14, late: str | None = None) -> DataFrame:
    """Bars of (ticker, session, high, low, close) with ema, rsi, atr, supertrend and super_up, from a few numbers kept for each ticker.

    The same recursions as in `indicators`: seeded at the first bar, Wilder means null before their number of values, and
    the same ratcheted bands.  Without `late`, a ticker's sessions must arrive in order, and each bar is given at once.
    With `late` (a watermark's delay), a ticker's bars wait in its state until the watermark passes them and are applied
    in order of session then, so that arrival may be shuffled within that time; a bar older than that, or a second one
    of a session, is dropped.  State holds the waiting bars and eleven numbers.
    """
    wait = late is not None
    names = ["ticker", "session", "close", "ema", "rsi", "atr", "supertrend", "super_up"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.nan, math.nan, -1, -(1 << 62), "[]")
        n, close, ema, gain, loss, atr, reach, top, bottom, follows, last, held = kept
        band = Band(top, bottom, close, None if follows < 0 else bool(follows))
        waiting = {at: bar for at, *bar in json.loads(held)}
        for batch in batches:
            micros = batch["session"].astype("datetime64[us]").astype("int64")
            for at, *bar in zip(micros.tolist(), batch["high"].tolist(), batch["low"].tolist(), batch["close"].tolist()):
                if not wait or at > last:
                    waiting.setdefault(at, bar)
        upto = state.getCurrentWatermarkMs() * 1000 if wait else 1 << 62
        out = []
        for at in sorted(k for k in waiting if k <= upto):
            high, low, now = waiting.pop(at)
            n, last = n + 1, at
            spread = high - low
            if n == 1:
                ema, atr, reach = now, spread, spread
            else:
                change = now - close
                up, down = max(change, 0.0), max(-change, 0.0)
                gain, loss = (up, down) if n == 2 else (gain + (up - gain) / period, loss + (down - loss) / period)
                spread = max(spread, abs(high - close), abs(low - close))
                ema += (now - ema) * 2 / (span + 1)
                atr += (spread - atr) / period
                reach += (spread - reach) / SUPER_PERIOD
            half = SUPER_FACTOR * reach if n >= SUPER_PERIOD else math.nan
            band, line, rising = band.step(now, (high + low) / 2 + half, (high + low) / 2 - half)
            close = now
            rsi = None if n <= period else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            out.append((key[0], pd.Timestamp(at, unit="us"), float(now), float(ema), rsi, float(atr) if n >= period else None, None if math.isnan(line) else line, rising))
        follows = -1 if band.follows_lower is None else int(band.follows_lower)
        state.update((n, *map(float, (close, ema, gain, loss, atr, reach, band.top, band.bottom)), follows, last, json.dumps([[at, *bar] for at, bar in waiting.items()])))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=names).astype({"session": "datetime64[us]", "rsi": float, "atr": float, "supertrend": float, "super_up": bool})

    schema = "ticker string, session timestamp, close double, ema double, rsi double, atr double, supertrend double, super_up boolean"
    kept = "n long, close double, ema double, gain double, loss double, atr double, reach double, top double, bottom double, follows int, last long, held string"
    rows = bars.withWatermark("session", late) if wait else bars
    return rows.groupBy("ticker").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def recalibrate(trades_path: str, weights_path: str, factors: tuple[str, ...], label: str = "pnl", last: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps closed trades and refits ridge weights on the newest `last` of them.

    The window of `last` trades is the feature itself.  Each batch writes its own folder, so a replayed
    batch replaces what it wrote before; weights carry the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{trades_path}/batch={number}")
        newest = spark.read.option("basePath", trades_path).parquet(trades_path).where(F.col("batch") <= number).orderBy(F.desc("closed_at"), F.desc("trade_id")).limit(last)
        found = fitting.ridge_weights(newest, factors, label)
        if found:
            rows = spark.createDataFrame(list(found.items()), "factor string, weight double")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{weights_path}/batch={number}")

    return write
