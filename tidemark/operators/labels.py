"""What a row's evidence may be called on display, and how old a snapshot is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses without a usable probability, and those of calibrated ones.
NO_PROBABILITY, CALIBRATED = ("UNAVAILABLE", "UNUSED", "NOT_APPLICABLE"), ("CALIBRATED", "CALIBRATED_OUT_OF_SAMPLE")
STALE_SECONDS, AHEAD_SECONDS = 15 * 60, 60


def probability_evidence(status: Column, value: Column) -> dict[str, Column]:
    """value, text, label and tone of a probability by its status; one outside 0 to 1, NaN or null is unavailable."""
    state = F.coalesce(F.when(status != "", status), F.lit("UNVERIFIED"))
    usable = F.coalesce((value >= 0) & (value <= 1) & ~F.isnan(value), F.lit(False)) & ~state.isin(*NO_PROBABILITY)
    sure = state.isin(*CALIBRATED)
    return {
        "value": F.when(usable, value),
        "text": F.when(~usable, "Unavailable").when(sure, F.format_string("%.0f%%", value * 100)).otherwise(F.format_string("%.2f", value)),
        "label": F.when(~usable, "Probability unavailable").when(sure, "Calibrated estimate").when(state == "HEURISTIC_UNVALIDATED", "Heuristic · unvalidated").otherwise("Unverified model output"),
        "tone": F.when(~usable, "muted").when(sure, "cyan").otherwise("amber"),
    }


def snapshot_freshness(text: Column, now: Column) -> dict[str, Column]:
    """state (recent, stale, future or unknown) and whole minutes of age of a snapshot's time; a text without a zone is unknown."""
    at = F.when(F.coalesce(text.rlike(r"(?i)(Z|[+-]\d{2}:\d{2})$"), F.lit(False)), F.try_to_timestamp(text))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at)
    state = F.when(age.isNull(), "unknown").when(age < -AHEAD_SECONDS * 1_000_000, "future").when(age > STALE_SECONDS * 1_000_000, "stale").otherwise("recent")
    return {"state": state, "minutes": F.when(state.isin("stale", "recent"), F.floor(F.greatest(F.lit(0), age) / 60_000_000))}


def ordered_unique(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by `order`, whatever the order of reading; null is a key as well."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")
