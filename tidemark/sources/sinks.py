"""Sinks: tables as CSV or JSON lines, report folders, and an append-only export with a verified prefix."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.readers import flat


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """df as CSV (nested columns as JSON text, with a header), JSON lines or Parquet, written by all tasks in parallel."""
    rows = flat(df) if kind == "csv" else df
    writer = rows.write.mode(mode)
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)


def write_report(folder: str, summary: DataFrame, tables: dict[str, DataFrame]) -> None:
    """A report: every table as CSV in a folder of its own, then the summary as JSON lines.

    The summary comes last, so that a folder with a summary is a whole report.
    """
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")
    write_table(summary, f"{folder}/summary", "json")


def write_audit(folder: str, daily: DataFrame, feeds: DataFrame, intervals: DataFrame, summary: DataFrame) -> None:
    """The tables of a coverage audit."""
    write_report(folder, summary, {"daily": daily, "feeds": feeds, "intervals": intervals})


def markdown(summary: dict[str, object], title: str) -> str:
    """A short report text of single figures; unknown ones show as such."""
    lines = [f"# {title}", ""]
    return "\n".join(lines + [f"* {k}: {'unknown' if v is None else v}" for k, v in summary.items()]) + "\n"


#: What is kept of every block of an export: its keys, the digest of its rows and of its last one, and the digest of the chain up to it.
CHAIN = "block int, first long, last long, n long, digest string, tail string, chain string"


def append_export(journal: DataFrame, path: str, key: str = "sequence") -> int:
    """Append to a JSON-lines export, as a block of its own, what the journal has after the export's last key; returns how many events.

    An append reads the last link of the chain, the journal's row of the last key exported, and the new rows: nothing
    that grows with the export.  If that row is gone or differs, or if the export has data but no chain, it
    raises ValueError and writes nothing.  `verify_export` compares the whole history.  A block becomes part of the
    export by its link, which is written last; what an interrupted append left is replaced by the next one.  One
    append runs at a time.  Keys are unique whole numbers that only grow.
    """
    spark: SparkSession = journal.sparkSession
    block = max(_blocks(spark, path), default=0)
    link = spark.read.schema(CHAIN).json(_link(path, block)).first() if block else None
    if link is None and _exists(spark, path) and not spark.read.schema(journal.schema).json(path).where(F.col(key).isNotNull()).isEmpty() and not _exists(spark, f"{path}/block=1"):
        raise ValueError("the export has no chain")
    fresh = journal
    if link is not None:
        tail = [r.line for r in journal.where(F.col(key) == link.last).select(_line(journal).alias("line")).limit(2).collect()]
        if len(tail) != 1 or _sha(tail[0]) != link.tail:
            raise ValueError("the export differs from the journal")
        fresh = journal.where(F.col(key) > link.last)
    if fresh.isEmpty():
        return 0
    place = f"{path}/block={block + 1}"
    fresh.write.mode("overwrite").json(place)
    # what counts is what was written
    found = _digests(spark.read.schema(journal.schema).json(place), key).first()
    chain = _sha(f"{link.chain if link else ''}:{found.first}:{found.last}:{found.n}:{found.digest}")
    row = spark.createDataFrame([(block + 1, found.first, found.last, found.n, found.digest, found.tail, chain)], CHAIN)
    row.coalesce(1).write.mode("overwrite").json(_link(path, block + 1))
    return found.n


def verify_export(journal: DataFrame, path: str, key: str = "sequence") -> DataFrame:
    """(block, key, fault) of an export against its chain and the journal; no rows if all is well.

    BLOCK_CHANGED: a block's rows don't give its digest; CHAIN_BROKEN: a link doesn't follow from the one before it;
    CHANGED, NOT_IN_JOURNAL, NOT_EXPORTED: single events, of the keys that the chain covers.  One join by key and one
    grouping by block; the chain has a row an append.
    """
    spark = journal.sparkSession
    blocks = _blocks(spark, path)
    if not blocks:
        return spark.createDataFrame([], "block int, key long, fault string")
    c = F.col
    links = spark.read.schema(CHAIN).json([_link(path, b) for b in blocks])
    rows = spark.read.schema(T.StructType([*journal.schema, T.StructField("block", T.IntegerType())])).option("basePath", path).json([f"{path}/block={b}" for b in blocks])
    now = _digests(rows, key, "block").select("block", c("digest").alias("__now"), c("n").alias("__n"))
    before = F.coalesce(F.lag("chain").over(Window.orderBy("block")), F.lit(""))
    due = F.sha2(F.concat_ws(":", before, *(c(n).cast("string") for n in ("first", "last", "n", "digest"))), 256)
    whole = links.withColumn("__due", due).join(now, "block", "left")
    fault = F.when(c("__due") != c("chain"), "CHAIN_BROKEN").when(c("__now").isNull() | (c("__now") != c("digest")) | (c("__n") != c("n")), "BLOCK_CHANGED")
    broken = whole.select("block", F.lit(None).cast("long").alias("key"), fault.alias("fault"))
    last = links.agg(F.max("last").alias("__last"))
    ours = journal.join(last, F.lit(True)).where(c(key) <= c("__last")).select(c(key).cast("long").alias("key"), _line(journal).alias("__ours"))
    theirs = rows.select(c(key).cast("long").alias("key"), "block", _line(journal).alias("__theirs"))
    both = ours.join(theirs, "key", "full_outer")
    single = F.when(c("__theirs").isNull(), "NOT_EXPORTED").when(c("__ours").isNull(), "NOT_IN_JOURNAL").when(c("__ours") != c("__theirs"), "CHANGED")
    return broken.unionByName(both.select("block", "key", single.alias("fault"))).where("fault is not null")


def _line(journal: DataFrame) -> Column:
    """A row as text, the same before and after it is exported: JSON leaves nulls out."""
    return F.to_json(F.struct(*journal.columns))


def _digests(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """first, last, n, tail and a digest that doesn't depend on the rows' order: sums of four parts of each row's hash."""
    names = [n for n in rows.columns if n not in by]
    line = F.sha2(F.to_json(F.struct(*names)), 256)
    parts = [F.sum(F.conv(F.substring("__sha", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return rows.withColumn("__sha", line).groupBy(*by).agg(
        F.min(key).cast("long").alias("first"), F.max(key).cast("long").alias("last"), F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", *parts), 256).alias("digest"), F.max_by("__sha", key).alias("tail")
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _link(path: str, block: int) -> str:
    return f"{path}/_chain/{block:08d}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _blocks(spark: SparkSession, path: str) -> list[int]:
    """The blocks with a complete link."""
    if not _exists(spark, f"{path}/_chain"):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_chain")
    names = [f.getPath().getName() for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    whole = [n for n in names if n.isdigit() and _exists(spark, f"{path}/_chain/{n}/_SUCCESS")]
    return sorted(map(int, whole))
