"""Registered queries of file scans and sinks: tables derived from the given ones are written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..stored import shared_folder
from ..streaming import streams
from .market import _register, r, rounded
from .views import DAY_MS, HOUR_MS, TICKS, candles, candles_sql, table, ticks

_YEAR = "year(make_timestamp(open_time_ms * 1000))"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bars as one file for each symbol and year, some of them spoilt: another header, a bad number, an open bar, a foreign row, a row too long."""
    x = candles(spark, d).withColumn("year", F.year(F.timestamp_millis("open_time_ms")))
    low = F.unix_millis(F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp"))
    bad = lambda k: (F.col("year") % 7 == k) & (F.col("open_time_ms") % (11 * DAY_MS) == 0)
    texts = {c: F.col(c).cast("decimal(38,18)").cast("string") for c in ("open", "high", "low", "close", "volume", "quote_volume")}
    x = x.select(
        F.lit("spot").alias("market"), "symbol", F.lit("1d").alias("interval"), low.alias("request_start_time_ms"), (low + 366 * DAY_MS).alias("request_end_time_ms"), "open_time_ms", "close_time_ms",
        *(v.alias(c) for c, v in texts.items()), "trade_count", texts["volume"].alias("taker_buy_base_volume"), F.col("taker_quote").cast("decimal(38,18)").cast("string").alias("taker_buy_quote_volume"), F.lit("true").alias("is_closed"), "year",
    )
    x = x.withColumns({"volume": F.when(bad(1), "much").otherwise(F.col("volume")), "is_closed": F.when(bad(2), "false").otherwise(F.col("is_closed")), "interval": F.when(bad(3), "2d").otherwise(F.col("interval")), "trade_count": F.when(bad(4), F.concat(F.col("trade_count").cast("string"), F.lit(".5"))).otherwise(F.col("trade_count").cast("string"))})
    path = _place(spark, "bars")
    # the year is a folder of its own; in the years of the sixth kind the header lacks a column
    out = x.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "open_time_ms").withColumn("in_symbol", F.col("symbol"))
    names = [*files.BAR_COLUMNS, "in_symbol", "year"]
    writer = lambda y: y.write.mode("append").partitionBy("in_symbol", "year").option("header", True).option("compression", "gzip")
    writer(out.where("year % 7 <> 6").select(*names)).csv(path)
    writer(out.where("year % 7 = 6").select(*names).drop("trade_count")).csv(path)
    return files.scan_strict(spark, f"{path}/*/*/*.csv.gz", files.BAR_COLUMNS, files.BAR_IDENTITY, fixed={"is_closed": "true"})


_FOLDERS = "in_symbol=([^/]+)/year=(\\d+)"
_LINES = f"""{candles_sql()}, files as (select *, {_YEAR} as y, row_number() over (partition by symbol, {_YEAR} order by open_time_ms) + 1 as line, open_time_ms % {11 * DAY_MS} = 0 as spoilt from candles),
 firsts as (select symbol, y, bool_or(spoilt and line = 2) as odd_first from files group by 1, 2),
 judged as (select f.*, case when y % 7 = 6 then 'short' when y % 7 = 3 and (spoilt <> odd_first) then 'identity' when y % 7 in (1, 2, 4) and spoilt then 'values' end as reason from files f join firsts using (symbol, y)),
 faulty as (select symbol, y from judged where reason is not null group by 1, 2)"""


@_register(
    "s01_csv_rows",
    f"with {_LINES} select symbol, open_time_ms, cast(line as bigint) as line, {r('close')} as close, {r('volume')} as volume, trade_count from judged j where not exists (select 1 from faulty f where f.symbol = j.symbol and f.y = j.y)",
)
def s01(spark, d):
    rows, _ = _scanned(spark, d)
    return rounded(rows.select("symbol", "open_time_ms", "line", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), "trade_count"))


@_register(
    "s01_csv_faults",
    f"""with {_LINES} select symbol as file_symbol, cast(y as integer) as file_year, cast(line as bigint) as line, reason from judged where reason in ('identity', 'values')
 union all select symbol, cast(y as integer), cast(1 as bigint), 'header' from judged where reason = 'short' group by 1, 2""",
)
def s01_faults(spark, d):
    _, faults = _scanned(spark, d)
    part = lambda i: F.regexp_extract("file", _FOLDERS, i)
    x = faults.select(part(1).alias("file_symbol"), part(2).cast("int").alias("file_year"), "line", "reason")
    # of a file without the right header the first line says it all
    return x.where("file_year % 7 <> 6 or line = 1")


@_register("s03_funding_files", f"with {TICKS}, rates as (select symbol, ts_ms - ts_ms % {8 * HOUR_MS} + {8 * HOUR_MS} as funding_time_ms, max(price) / 100000 as rate from ticks group by 1, 2) select symbol, funding_time_ms, {r('rate', 8)} as rate, case when funding_time_ms % 3 = 0 then {r('rate * 2', 8)} end as mark_price from rates")
def s03(spark, d):
    time = F.expr(f"ts_ms - ts_ms % {8 * HOUR_MS}L + {8 * HOUR_MS}L")
    f = ticks(spark, d).groupBy("symbol", time.alias("funding_time_ms")).agg((F.max("price") / 100_000).alias("rate"))
    span = f.groupBy("symbol").agg(F.min("funding_time_ms").alias("start_time_ms"), F.max("funding_time_ms").alias("end_time_ms"))
    x = f.join(span, "symbol").withColumn("mark_price", F.when(F.col("funding_time_ms") % 3 == 0, F.col("rate") * 2))
    path = _place(spark, "funding")
    files.write_strict(x, path, list(files.FUNDING_COLUMNS), files.FUNDING_IDENTITY, ["funding_time_ms"])
    rows, _ = files.scan_strict(spark, f"{path}/*/*/*/*.csv.gz", files.FUNDING_COLUMNS, files.FUNDING_IDENTITY, ("mark_price",))
    return rounded(rows.select("symbol", "funding_time_ms", "rate", "mark_price"), 8)


@_register("s02_repeated_sink", f"with {candles_sql()} select symbol, {_YEAR} as year, count(*) as n, {r('sum(case when ' + _YEAR + ' % 2 = 0 then close + 1 else close end)', 4)} as closes from candles group by 1, 2")
def s02(spark, d):
    x = candles(spark, d).withColumn("year", F.year(F.timestamp_millis("open_time_ms"))).select("symbol", "year", "open_time_ms", "close")
    path = _place(spark, "sink")
    files.replace_partitions(x, path, ["symbol", "year"], ["open_time_ms"])
    mended = x.where("year % 2 = 0").withColumn("close", F.col("close") + 1)
    for _ in range(2):  # the second write changes nothing
        files.replace_partitions(mended, path, ["symbol", "year"], ["open_time_ms"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy("symbol", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("close").alias("closes")), 4)


@_register("s11_raw_events", "select event_type as market, strftime(cast(ts as timestamp), '%Y-%m-%d') as day, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1, 2")
def s11(spark, d):
    events = streams.file_stream(spark, d, "events")
    rows = events.select(F.col("event_type").alias("market"), F.unix_millis("ts").alias("received_at_ms"), F.struct("event_id", "user_id", "value").alias("payload"))
    path = _place(spark, "raw")
    files.raw_events(rows, path, _place(spark, "raw-state")).awaitTermination()
    back = spark.read.schema("market string, received_at_ms long, payload struct<event_id: long, user_id: long, value: double>, in_market string, day string").json(path)
    return back.groupBy("market", "day").agg(F.count("*").alias("n"), F.sum("payload.event_id").alias("ids"))


@_register("s16_artifacts", "select 'csv' as kind, o_orderpriority, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 2 union all select 'json', o_orderpriority, count(*), cast(sum(o_orderkey) as bigint) from orders group by 2 union all select 'parquet', o_orderpriority, count(*), cast(sum(o_orderkey) as bigint) from orders group by 2")
def s16(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = []
    for kind in ("csv", "json", "parquet"):
        path = _place(spark, kind)
        files.write_artifact(x, path, ["o_orderpriority", "o_orderkey"], kind)
        back = spark.read.schema(x.schema).option("header", True).format(kind).load(path)
        parts.append(back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(kind).alias("kind"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("o01_output_order", "select o_orderkey, row_number() over (order by o_orderdate desc, o_custkey, o_orderkey) as place, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_custkey, o_orderkey) as own_place from orders")
def o01(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    order = [F.desc("o_orderdate"), "o_custkey", "o_orderkey"]
    x = files.numbered(files.numbered(x, order), order, "own_place", ["o_orderpriority"])
    return x.select("o_orderkey", "place", "own_place")
