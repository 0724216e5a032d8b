"""Plug points: functions from DataFrame to DataFrame with declared columns, checked before a plan is built on them.

A plug names the columns that it needs and those that it gives.  `apply` checks the first against the input's
schema, calls the function, and checks its result's schema: given columns must be there with their types, and the
input's columns must come through unless the plug says that it makes rows of its own.  Both checks read schemas only, so a
wrong plug fails on the driver before any task runs, with all faults in one message.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlugError(ValueError):
    """A plug's input or result lacks columns, or has them with other types."""


class Plug(NamedTuple):
    """`needs` and `gives` are DDL; `keeps` says that the input's columns come through."""

    name: str
    needs: str
    gives: str
    run: Callable[[DataFrame], DataFrame]
    keeps: bool = True

    def apply(self, rows: DataFrame) -> DataFrame:
        _check(f"{self.name} needs", rows, T.StructType.fromDDL(self.needs))
        out = self.run(rows)
        if not isinstance(out, DataFrame):
            raise PlugError(f"{self.name} gives {type(out).__name__} and no DataFrame")
        _check(f"{self.name} gives", out, T.StructType.fromDDL(self.gives))
        lost = [c for c in rows.columns if self.keeps and c not in out.columns]
        if lost:
            raise PlugError(f"{self.name} drops {', '.join(lost)}")
        return out


def _check(what: str, rows: DataFrame, wanted: T.StructType) -> None:
    have = {f.name: f.dataType for f in rows.schema}
    faults = [f"{f.name} {f.dataType.simpleString()} (is {have[f.name].simpleString() if f.name in have else 'missing'})" for f in wanted if have.get(f.name) != f.dataType]
    if faults:
        raise PlugError(f"{what} {', '.join(faults)}")


def column(name: str, needs: str, gives: str, value: Callable[[], Column]) -> Plug:
    """A plug that adds one column (`gives` is "name type")."""
    field = T.StructType.fromDDL(gives)[0]
    return Plug(name, needs, gives, lambda rows: rows.withColumn(field.name, value().cast(field.dataType)))


def probability_gate(value: Callable[[], Column]) -> Plug:
    """The least probability of a candidate, by its regime or anything else a scan knows."""
    return column("probability gate", "session timestamp, ticker string, regime string, direction string", "least_probability double", value)


def capital_scaler(value: Callable[[], Column]) -> Plug:
    """The share of the usual risk that a candidate's size is scaled by."""
    return column("capital scaler", "session timestamp, regime string", "capital_fraction double", value)


def weight_provider(weights: Callable[[DataFrame], DataFrame]) -> Plug:
    """Candidates with an array of factor weights, in the order of factors.NAMES."""
    return Plug("weight provider", "session timestamp, regime string", "factor_weights array<double>", weights)


def signal_provider(run: Callable[[DataFrame], DataFrame]) -> Plug:
    """Signals from bars with indicators: what a fold's last session picks, or any other rows of this form."""
    return Plug("signal provider", "ticker string, session timestamp, close double, atr double", "ticker string, entry double, stop double, target double, direction string, time_stop int", run, keeps=False)


def entry_guard(reason: Callable[[], Column]) -> Plug:
    """A reason not to enter, or null; rows with a reason are refused."""
    return column("entry guard", "ticker string, entry double, stop double", "guard_reason string", reason)


def bar_provider(run: Callable[[DataFrame], DataFrame]) -> Plug:
    """Bars for a table of (ticker)."""
    return Plug("bar provider", "ticker string", "ticker string, session timestamp, open double, high double, low double, close double, volume double", run, keeps=False)


def guarded(rows: DataFrame, guards: tuple[Plug, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with guard_reason): the first guard with a reason decides."""
    marked = rows.withColumn("__reason", F.lit(None).cast("string"))
    for guard in guards:
        marked = guard.apply(marked).withColumn("__reason", F.coalesce("__reason", "guard_reason")).drop("guard_reason")
    accepted = marked.where("__reason is null").drop("__reason")
    return accepted, marked.where("__reason is not null").withColumnRenamed("__reason", "guard_reason")
