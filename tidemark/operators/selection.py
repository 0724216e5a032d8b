"""Return correlations and order-dependent selection of a session's candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import correlation, framed_correlation
from tidemark.operators import book


def returns(bars: DataFrame) -> DataFrame:
    """(ticker, session, ret): close to close."""
    w = Window.partitionBy("ticker").orderBy("session")
    return bars.select("ticker", "session", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret is not null")


def pair_correlations(rets: DataFrame, tail: int | None = 60, least: int = 20) -> DataFrame:
    """(a, b, corr, n) of each pair of tickers (a < b) over their common sessions among the last `tail`.

    Sessions are the join key: a session's tickers, a bounded set, meet, and partial sums leave one row
    a pair and task.
    """
    if tail:
        last = rets.select("session").distinct().orderBy(F.desc("session")).limit(tail)
        rets = rets.join(F.broadcast(last), "session", "left_semi")  # at most `tail` small rows
    a = rets.select("session", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = rets.select("session", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    pairs = a.join(b, "session").where("a < b").groupBy("a", "b").agg(correlation("x", "y").alias("corr"), F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least)


def session_correlations(rets: DataFrame, at: DataFrame, tail: int = 60, least: int = 20, sessions: DataFrame | None = None) -> DataFrame:
    """(session, a, b, corr, n) of each pair (a < b) of a session's tickers over their common sessions among the `tail` that end there.

    at: session, ticker.  Nothing after a session is read for it.  sessions (session) are those to count, one small row
    each, all those of rets and at if not given.  A pair's returns and its places in `at` are one partition, read
    once; `at` is read once too, as its plan may be a long one.
    """
    if sessions is None:
        sessions = rets.select("session").union(at.select("session"))
    days = sessions.select("session").distinct().select("session", F.row_number().over(Window.orderBy("session")).alias("__ord"))
    own = at.groupBy("session").agg(F.collect_set("ticker").alias("__all")).select("session", "__all", F.explode("__all").alias("a"))
    wanted = own.select("session", "a", F.explode(F.filter("__all", lambda t: t > F.col("a"))).alias("b"))
    a = rets.select("session", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = rets.select("session", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    rows = a.join(b, "session").where("a < b").select("session", "a", "b", "x", "y", F.lit(False).alias("__at"))
    nothing = F.lit(None).cast("double")
    rows = rows.unionByName(wanted.select("session", "a", "b", nothing.alias("x"), nothing.alias("y"), F.lit(True).alias("__at"))).join(F.broadcast(days), "session")
    frame = Window.partitionBy("a", "b").orderBy("__ord").rangeBetween(1 - tail, 0)
    n = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(frame)
    found = rows.select("session", "a", "b", framed_correlation("x", "y", frame).alias("corr"), n.alias("n"), "__at")
    return found.where(F.col("__at") & (F.col("n") >= least)).drop("__at")


def select_portfolio(candidates: DataFrame, pairs: DataFrame, size: int = 6, per_sector: int = 2, most_corr: float = 0.75, pool: int = 200) -> DataFrame:
    """Candidates chosen a session: held ones first, then by rank under sector and correlation caps.

    candidates: session, ticker, sector, rank_score, held; pairs: a, b, corr, and session if they differ by it.
    The choice depends on its order, so a session's candidates are one task's sorted stream, read until its
    book is full or none is left, `pool` at a time less those of full sectors.  A pair without a correlation passes.
    """
    dated = [c for c in ("session",) if c in pairs.columns]
    w = Window.partitionBy("session").orderBy(F.desc("held"), F.desc("rank_score"), "ticker")
    placed = candidates.withColumn("place", F.row_number().over(w))
    ends = F.explode(F.array(F.struct(F.col("a").alias("ticker"), "b"), F.struct(F.col("b").alias("ticker"), F.col("a").alias("b")))).alias("__e")
    both = pairs.where(F.abs("corr") > most_corr).select(*dated, ends).select(*dated, "__e.*")
    close = both.groupBy(*dated, "ticker").agg(F.collect_set("b").alias("close_to"))
    rows = placed.join(close, [*dated, "ticker"], "left").repartition("session").sortWithinPartitions("session", "place")

    columns = [*candidates.columns, "place"]

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, sectors = [], {}  # the book of the session that is read, over parts
        for part in parts:
            starts, keep = np.flatnonzero(part["place"].to_numpy() == 1).tolist(), []
            bounds = sorted({0, *starts, len(part)})
            for first, end in zip(bounds, bounds[1:]):
                if first in starts:
                    taken, sectors = [], {}
                for k in range(first, end, pool):
                    if len(taken) >= size:
                        break
                    some = part.iloc[k : min(k + pool, end)].assign(row_=range(k, min(k + pool, end)))
                    full = [s for s, n in sectors.items() if n >= per_sector]
                    some = some[some["held"].eq(True) | ~some["sector"].isin(full)]
                    for r in some.itertuples():
                        near = set(r.close_to) if r.close_to is not None else set()
                        if len(taken) < size and (r.held or sectors.get(r.sector, 0) < per_sector and not near.intersection(taken)):
                            keep.append(r.row_)
                            taken.append(r.ticker)
                            sectors[r.sector] = sectors.get(r.sector, 0) + 1
            yield part.iloc[keep][columns]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", place int"
    return rows.mapInPandas(choose, schema)


def choose_book(candidates: DataFrame, pairs: DataFrame, capital: float, most_risk: float, size: int = 6, per_sector: int = 2, most_corr: float = 0.75) -> DataFrame:
    """A session's whole selection: select_portfolio's choice, held within capital and risk by book.within_limits.

    candidates: session, ticker, sector, rank_score, held, shares, entry, stop, risk.  Limits act on what was chosen; a place
    that they empty isn't filled again.
    """
    return book.within_limits(select_portfolio(candidates, pairs, size, per_sector, most_corr), capital, most_risk)


def non_overlapping(trades: DataFrame) -> DataFrame:
    """Trades of one setup and ticker that start after the last kept one has ended (entry_ord, exit_ord)."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        rows, until = [], -1
        for k, r in enumerate(group.sort_values(["entry_ord", "trade_id"]).itertuples(index=False)):
            if r.entry_ord > until:
                rows.append(k)
                until = r.exit_ord
        return group.sort_values(["entry_ord", "trade_id"]).iloc[rows]

    return trades.groupBy("setup", "ticker").applyInPandas(keep, trades.schema)


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `turn`: the first of every group, then the second of every group, and so on."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", place).orderBy("turn", group)


#: Limits of an allocation, as shares of the net asset value, and of correlation.
MAX_HEAT, MAX_SECTOR, MAX_ABS_CORR = 0.06, 0.30, 0.75


def allocate(
    candidates: DataFrame, pairs: DataFrame, held: DataFrame | None = None, nav: float = 1_000_000.0, size: int = 6, per_sector: int = 2, risk_limit: float = 30_000.0, heat: float = MAX_HEAT, sector_share: float = MAX_SECTOR, most_corr: float = MAX_ABS_CORR
) -> DataFrame:
    """(session, ticker, sector, shares, reason, price, risk) of every candidate, in order of its rank, under a book's limits.

    candidates: session, ticker, sector, rank_score, quantity, price, stop, risk_scale; held: session, ticker,
    sector, shares, price, risk; pairs: a, b, corr, and session if they differ by it.  What a candidate gets depends on those before it, so a session is one
    group; all candidates get a row, with the first limit that stopped them.  Unlike in
    select_portfolio an unknown correlation with the book blocks.
    """
    dated = [c for c in ("session",) if c in pairs.columns]
    ends = F.explode(F.array(F.struct(F.col("a").alias("ticker"), "b"), F.struct(F.col("b").alias("ticker"), F.col("a").alias("b")))).alias("__e")
    both = pairs.select(*dated, ends, "corr").select(*dated, "__e.*", "corr")
    known = both.groupBy(*dated, "ticker").agg(F.map_from_entries(F.collect_list(F.struct("b", "corr"))).alias("known"))
    names = ["session", "ticker", "sector", "rank_score", "quantity", "price", "stop", "risk_scale"]
    rows = candidates.select(*names).withColumns({"held": F.lit(False), "held_risk": F.lit(0.0)})
    if held is not None:
        own = held.select("session", "ticker", "sector", F.lit(None).cast("double").alias("rank_score"), F.col("shares").cast("long").alias("quantity"), "price", F.lit(None).cast("double").alias("stop"), F.lit(1.0).alias("risk_scale"), F.lit(True).alias("held"), F.col("risk").alias("held_risk"))
        rows = rows.withColumn("quantity", F.col("quantity").cast("long")).unionByName(own)
    rows = rows.join(known, [*dated, "ticker"], "left")
    rows = rows.withColumn("known", F.coalesce(F.to_json("known"), F.lit("{}")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import json

        filled = [dict(ticker=r.ticker, sector=r.sector, value=r.quantity * r.price, risk=r.held_risk) for r in group[group["held"]].itertuples()]
        cash = max(0.0, nav - sum(p["value"] for p in filled))
        out = []
        for r in group[~group["held"]].sort_values(["rank_score", "ticker"], ascending=[False, True]).itertuples():
            correlations = json.loads(r.known)
            reason, shares = "", 0
            if any(p["ticker"] == r.ticker for p in filled):
                reason = "already_held"
            elif len(filled) >= size:
                reason = "position_cap"
            elif sum(p["sector"] == r.sector for p in filled) >= per_sector:
                reason = "sector_cap"
            else:
                for p in filled:
                    value = correlations.get(p["ticker"])
                    if value is None or abs(value) >= most_corr:
                        reason = "correlation_unknown" if value is None else "correlation_cap"
                        break
            if not reason and not (r.price > r.stop > 0 and r.quantity >= 0 and 0 <= r.risk_scale <= 1):
                reason = "invalid_allocation_inputs"
            elif not reason and r.risk_scale == 0:
                reason = "breadth_defensive"
            elif not reason:
                room = max(0.0, min(risk_limit, nav * heat) - sum(p["risk"] for p in filled))
                by_heat = int(room / (r.price - r.stop))
                by_sector = int(max(0.0, nav * sector_share - sum(p["value"] for p in filled if p["sector"] == r.sector)) / r.price)
                shares = min(int(r.quantity * r.risk_scale), by_heat, by_sector, int(cash / r.price))
                reason = "heat_cap" if by_heat <= 0 else "sector_exposure_cap" if by_sector <= 0 else "allocated" if shares > 0 else "cash_or_size_cap"
                shares = max(shares, 0)
            risk = shares * max(0.0, r.price - r.stop)
            out.append((r.session, r.ticker, r.sector, shares, reason, r.price, risk))
            if shares:
                filled.append(dict(ticker=r.ticker, sector=r.sector, value=shares * r.price, risk=risk))
                cash -= shares * r.price
        return pd.DataFrame(out, columns=["session", "ticker", "sector", "shares", "reason", "price", "risk"])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return rows.groupBy("session").applyInPandas(run, f"session {kinds['session']}, ticker string, sector {kinds['sector']}, shares long, reason string, price double, risk double")
