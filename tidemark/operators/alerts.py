"""Alerts of a scan's best candidates: a floor of probability, no key again within some hours, and a top N.

What a scan sends depends on what earlier ones of its channel sent, so a channel's scans are read in order, with the keys sent
within the last hours as the only state.  A key that misses the top N wasn't sent and may be sent by the next scan.

Defined results: a null probability or key is never sent; repeated keys of a scan count once, the best placed; of equal places the
lesser key comes first.  A key is free again exactly `hours` after it was sent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def send(sent: dict[str, int], at: int, labels: Iterable, scan: Iterable[tuple[str, float]], least: float, hours: float, top: int) -> list:
    """The labels of what a scan at `at` (microseconds) sends, best first; `sent` (key -> time) forgets and learns."""
    free = at - int(hours * 3_600_000_000)
    for key in [k for k, t in sent.items() if t <= free]:
        del sent[key]
    chosen = []
    for label, (key, probability) in zip(labels, scan):
        if len(chosen) == top:
            break
        if key is not None and probability is not None and probability >= least and key not in sent:
            sent[key] = at
            chosen.append(label)
    return chosen


def alerts(candidates: DataFrame, least: float = 0.55, hours: float = 4.0, top: int = 5) -> DataFrame:
    """(channel, ts, key, probability) that are sent, from candidates (channel, ts, key, place, probability); place orders a scan.

    Channels are dealt by hash and read as one sorted stream, so a task holds one scan and the keys of the last hours.
    """
    names = ["channel", "ts", "key", "probability"]
    rows = candidates.select("channel", "ts", "place", "key", "probability").repartition("channel").sortWithinPartitions("channel", "ts", "place", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sent, scan = None, {}, []

        def settle() -> list[tuple]:
            return [scan[k] for k in send(sent, now[1].value // 1000, range(len(scan)), ((r[2], r[3]) for r in scan), least, hours, top)]

        for batch in batches:
            out = []
            for channel, ts, key, probability in zip(batch["channel"], batch["ts"], batch["key"], batch["probability"]):
                if now != (channel, ts):
                    if scan:
                        out += settle()
                    if now is None or now[0] != channel:
                        sent = {}
                    now, scan = (channel, ts), []
                scan.append((channel, ts, key, probability))
            yield pd.DataFrame(out, columns=names)
        if scan:
            yield pd.DataFrame(settle(), columns=names)

    schema = ", ".join(f"`{n}` {candidates.schema[n].dataType.simpleString()}" for n in names)
    return rows.where(F.col("channel").isNotNull() & F.col("ts").isNotNull()).mapInPandas(run, schema)
