"""Strict file scans and repeatable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import written

#: Columns of a bar file, in order, with their types; the first three and the requested range are one for a whole file.
BAR_COLUMNS = {
    "market": "string", "symbol": "string", "interval": "string", "request_start_time_ms": "long", "request_end_time_ms": "long", "open_time_ms": "long", "close_time_ms": "long",
    "open": "decimal(38,18)", "high": "decimal(38,18)", "low": "decimal(38,18)", "close": "decimal(38,18)", "volume": "decimal(38,18)", "quote_volume": "decimal(38,18)",
    "trade_count": "long", "taker_buy_base_volume": "decimal(38,18)", "taker_buy_quote_volume": "decimal(38,18)", "is_closed": "string",
}
BAR_IDENTITY = ["market", "symbol", "interval", "request_start_time_ms", "request_end_time_ms"]
FUNDING_COLUMNS = {"symbol": "string", "start_time_ms": "long", "end_time_ms": "long", "funding_time_ms": "long", "rate": "double", "mark_price": "double"}
FUNDING_IDENTITY = ["symbol", "start_time_ms", "end_time_ms"]


def scan_strict(spark: SparkSession, path: str, columns: dict[str, str], identity: list[str], optional: tuple[str, ...] = (), fixed: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the good files under ``path``, and (file, line, reason) of what is wrong in the others.

    Files are gzip CSV without line breaks in fields, so each is read by one
    task and its lines are in order.  A file is good if its first line is the
    header, it has rows, all of them have the identity of the first, every value
    is of its type (empty only where ``optional``) and columns of ``fixed`` have
    that text.  Reasons: header, empty, identity, values (of a line the first
    that applies); any makes the whole file go.  Rows have ``file`` and ``line``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    lines = written(lines)
    firsts = lines.groupBy("file").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    names = ", ".join(f"`{c}` string" for c in columns)
    x = lines.join(firsts, "file").withColumn("line", F.col("_id") - F.col("_first") + 1)
    # a field too many goes into the last column, which then is not of its type
    x = x.withColumn("r", F.from_csv("value", f"{names}, `_more` string", {"mode": "PERMISSIVE"}))
    typed = [F.col(f"r.{c}").try_cast(t).alias(c) for c, t in columns.items()]
    x = x.select("file", "line", "_lines", "value", F.struct(*(f"r.{c}" for c in identity)).alias("_identity"), F.col("r._more").alias("_more"), *(F.col(f"r.{c}").alias(f"_raw_{c}") for c in columns), *typed)
    first = x.where("line = 2").select("file", F.col("_identity").alias("_own"))
    x = x.join(first, "file", "left")
    wrong = F.col("_more").isNotNull()
    for c in columns:
        missing = F.col(f"_raw_{c}").isNull() | (F.col(f"_raw_{c}") == "")
        bad = F.col(c).isNull()
        wrong = wrong | ((bad & ~missing) if c in optional else (bad | missing))
    for c, text in (fixed or {}).items():
        wrong = wrong | (F.col(f"_raw_{c}") != text)
    reason = F.when((F.col("line") == 1) & (F.col("value") != ",".join(columns)), "header").when((F.col("line") == 1) & (F.col("_lines") == 1), "empty")
    reason = reason.when((F.col("line") > 1) & ~F.col("_identity").eqNullSafe(F.col("_own")), "identity").when((F.col("line") > 1) & F.coalesce(wrong, F.lit(True)), "values")
    judged = written(x.select("file", "line", reason.alias("reason"), *columns))
    faults = judged.where("reason is not null").select("file", "line", "reason")
    rows = judged.where("line > 1").join(faults.select("file").distinct(), "file", "left_anti")
    return rows.select(*columns, "file", "line"), faults


def write_strict(rows: DataFrame, path: str, columns: list[str], identity: list[str], order: list[str], mode: str = "error") -> None:
    """Gzip CSV with a header, ``columns`` in their order; each file has one identity and its rows in ``order``.

    Files lie in a folder for each value of ``identity``, so a reader can pass
    over others by name; writing the same rows again gives the same lines.
    """
    copies = [F.col(c).alias(f"in_{c}") for c in identity]
    x = rows.select(*columns, *copies).repartition(*identity).sortWithinPartitions(*identity, *order)
    x.write.mode(mode).partitionBy(*(f"in_{c}" for c in identity)).option("header", True).option("compression", "gzip").csv(path)


def replace_partitions(rows: DataFrame, path: str, partitions: list[str], order: list[str]) -> None:
    """Parquet by ``partitions``: those that ``rows`` have are replaced whole, others stay, so a repeated write changes nothing."""
    x = rows.repartition(*partitions).sortWithinPartitions(*partitions, *order)
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def raw_events(stream: DataFrame, path: str, checkpoint: str):
    """Starts a sink of (market, received_at_ms, payload) as JSON lines by market and UTC day; each row arrives once, whatever is retried."""
    day = F.date_format(F.timestamp_millis("received_at_ms"), "yyyy-MM-dd")
    x = stream.select(F.col("market").alias("in_market"), day.alias("day"), "market", "received_at_ms", "payload")
    return x.writeStream.format("json").partitionBy("in_market", "day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_artifact(rows: DataFrame, path: str, order: list[str], kind: str = "parquet") -> None:
    """A result in canonical order (``order``, then all other columns), as Parquet, CSV with a header, or JSON lines; several files in one sequence."""
    rest = [c for c in rows.columns if c not in order]
    x = rows.orderBy(*order, *rest)
    writer = x.write.mode("error")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place", by: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the row's number from 1 in the order, or in that of its ``by`` group, without one task for all rows.

    Rows are sorted by range over all tasks and written; a row's number is its
    place in its part and the sizes of the parts before, which are one row each.
    Equal rows share a part.
    """
    keys = [*(by or []), *order]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    parts = written(parts).withColumn("_part", F.shiftright("_at", 33))
    sizes = parts.groupBy(*(by or []), "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    # one row a part, or a group and part
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # groups are matched with nulls equal
    match = F.col("p._part") == F.col("s._part")
    for c in by or []:
        match = match & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    found = parts.alias("p").join(sizes.alias("s"), match)
    return found.select("p.*", (F.col("p._at") - F.col("s._low") + F.col("s._before") + 1).alias(name)).drop("_at", "_part")
