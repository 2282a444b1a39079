"""Feed runs over events: batch forms and streams over landed files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators import feeds as B
from lexigrain.operators import run_ledger as L
from lexigrain.operators.rows import FIRST_VERSION_RUN_SECONDS, recent
from lexigrain.registry.core import query, table
from lexigrain.session import shared_path
from lexigrain.streaming import batches as Y
from lexigrain.streaming import feeds as X

# event_type is the feed, ts the publication time, value the latency; an entry is
# seen value * 20 seconds after it was published
_ENTRY = """e AS (SELECT event_id, event_type AS feed_name, ts, value AS latency,
    epoch_us(ts) / 1e6 AS published, epoch_us(ts) / 1e6 + value * 20 AS seen FROM events),
    r AS (SELECT *, (round(seen / 900.0) * 900)::BIGINT AS run_id FROM e)"""

_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def entries(events):
    return events.select(
        "event_id", F.col("event_type").alias("feed_name"),
        F.col("ts").cast("timestamp").alias("published"), F.col("value").alias("latency"))


def seen(published="published"):
    return B.epoch_seconds(F.col(published)) + F.col("latency") * 20


@query("run_buckets", f"WITH {_ENTRY} SELECT event_id, run_id, "
                      "(round(seen / 3600.0) * 3600)::BIGINT AS hourly_run FROM r")
def run_buckets(spark, sf_dir):
    return entries(table(spark, sf_dir, "events")).select(
        "event_id", B.run_bucket(seen()).alias("run_id"),
        B.run_bucket(seen(), FIRST_VERSION_RUN_SECONDS).alias("hourly_run"))


@query("recent_entries", f"""
    WITH {_ENTRY} SELECT event_id, run_id FROM r WHERE run_id - published <= 900""")
def recent_entries(spark, sf_dir):
    return X.due_entries(entries(table(spark, sf_dir, "events")), seen()).select(
        "event_id", "run_id")


@query("recent_entries_bounded", f"""
    WITH {_ENTRY} SELECT event_id, run_id FROM r WHERE run_id - published BETWEEN -60 AND 3600""")
def recent_entries_bounded(spark, sf_dir):
    e = entries(table(spark, sf_dir, "events")).withColumn("run_id", B.run_bucket(seen()))
    return e.filter(recent(F.col("run_id"), B.epoch_seconds(F.col("published")),
                           FIRST_VERSION_RUN_SECONDS, 60)).select("event_id", "run_id")


@query("run_statistics", f"""
    WITH {_ENTRY}, g AS (SELECT DISTINCT run_id, feed FROM r, (SELECT DISTINCT event_type AS feed
        FROM events UNION ALL SELECT 'silent'))
    SELECT g.run_id, feed AS feed_name, count(r.event_id) AS article_count,
           round(coalesce(avg(latency), 0), 6) AS article_avg
    FROM g LEFT JOIN r ON r.run_id = g.run_id AND r.feed_name = feed GROUP BY ALL""")
def run_statistics(spark, sf_dir):
    e = entries(table(spark, sf_dir, "events")).withColumn("run_id", B.run_bucket(seen()))
    catalogue = e.select("feed_name").distinct().unionByName(
        spark.createDataFrame([("silent",)], "feed_name string"))
    return B.run_statistics(e, catalogue).withColumn("article_avg", F.round("article_avg", 6))


_WINDOWS = """
    SELECT strftime(time_bucket(INTERVAL 15 minutes, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
           event_type AS feed_name, count(*) AS article_count, round(avg(value), 6) AS article_avg
    FROM events {where} GROUP BY ALL"""


def _window_rows(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "feed_name", "article_count", F.round("article_avg", 6).alias("article_avg"))


@query("window_statistics", _WINDOWS.format(where=""))
def window_statistics(spark, sf_dir):
    return _window_rows(B.window_statistics(entries(table(spark, sf_dir, "events"))))


@query("late_entries", f"""
    WITH {_ENTRY} SELECT feed_name, count(*) AS late FROM r WHERE run_id - published > 900
    GROUP BY feed_name""")
def late_entries(spark, sf_dir):
    e = entries(table(spark, sf_dir, "events")).withColumn("run_id", B.run_bucket(seen()))
    late = ~recent(F.col("run_id"), B.epoch_seconds(F.col("published")))
    return e.filter(late).groupBy("feed_name").agg(F.count("*").alias("late"))


def _stream(spark, sf_dir):
    return entries(X.stream_parquet(spark, sf_dir, _EVENTS, "events.parquet"))


def _land(spark, df, label):
    path = shared_path(spark, label)
    X.run_available(df, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("stream_recent_entries", f"""
    WITH {_ENTRY} SELECT event_id, run_id FROM r WHERE run_id - published <= 900""")
def stream_recent_entries(spark, sf_dir):
    due = X.due_entries(_stream(spark, sf_dir), seen()).select("event_id", "run_id")
    return _land(spark, due, "recent-entries")


@query("stream_window_statistics", _WINDOWS.format(where="""
    WHERE time_bucket(INTERVAL 15 minutes, ts) + INTERVAL 15 minutes
          <= (SELECT max(ts) FROM events) - INTERVAL 15 minutes"""))
def stream_window_statistics(spark, sf_dir):
    """Closed windows only: those the watermark has passed when the input ends."""
    return _window_rows(_land(spark, X.stream_window_statistics(
        _stream(spark, sf_dir)), "window-statistics"))


@query("stream_distinct_entries", "SELECT event_id, event_type AS feed_name FROM events")
def stream_distinct_entries(spark, sf_dir):
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = X.stream_distinct_entries(twice, "event_id").select("event_id", "feed_name")
    return _land(spark, once, "distinct-entries")


@query("stream_routed_entries", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 90 THEN 'slow' END
           AS reason FROM events""")
def stream_routed_entries(spark, sf_dir):
    path = shared_path(spark, "routed-entries")
    stream = _stream(spark, sf_dir)
    X.start_routed(stream, {"failed": F.col("feed_name") == "error",
                            "slow": F.col("latency") > 90},
                   f"{path}/good", f"{path}/rejected", f"{path}/checkpoint").awaitTermination()
    good = spark.read.schema("event_id long, batch_id long").parquet(f"{path}/good")
    bad = spark.read.schema("event_id long, reason string, batch_id long").parquet(
        f"{path}/rejected")
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", "reason"))


#: Events land in five files by time; every third click arrives two files late.
_DELIVERED = """
    spread AS (SELECT *, least(4, 5 * (epoch_us(ts) - min(epoch_us(ts)) OVER ())
        // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ())) AS part FROM events),
    landed AS (SELECT *, least(4, part + CASE WHEN event_type = 'click' AND event_id % 3 = 0
        THEN 2 ELSE 0 END) AS file FROM spread)"""


ALL_FILES = 1 << 30  # of one delivery, in one batch


def _with_file(events):
    """Events with the number of the file that brings them."""
    found = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = found.agg(F.min("at"), F.max("at")).head()
    part = F.least(F.lit(4), F.expr(f"5 * (at - {low}) div {high - low}"))
    moved = F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), 2).otherwise(0)
    return found.withColumn("file", F.least(F.lit(4), part + moved)).drop("at")


def _land_files(spark, sf_dir):
    """Write the deliveries, each into a folder of its own by as many tasks as read it."""
    files = _with_file(table(spark, sf_dir, "events"))
    path = shared_path(spark, "landed")
    folders = [f"{path}/delivery-{number}" for number in range(5)]
    for number, folder in enumerate(folders):
        files.filter(F.col("file") == number).drop("file").write.parquet(folder)
    return folders


def _land_batches(spark, sf_dir, write, runs=("first",), times=1):
    """The folder of what batches of one delivery each left; ``write`` gets it.

    A run takes the deliveries one after the other, and goes on from its checkpoint. Their
    folders are given as patterns, since a plain one would be the base path of all batches.
    """
    path, landed = shared_path(spark, "batches"), _land_files(spark, sf_dir)
    for run in runs:
        for folder in landed:
            found = f"{folder[:-1]}[{folder[-1]}]"
            stream = entries(X.stream_parquet(spark, found, _EVENTS, max_files=ALL_FILES))
            copies = stream.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
            Y.start_batches(copies.drop("copy"), write(path), f"{path}/checkpoint-{run}",
                            f"{path}/log", run).awaitTermination()
    return path


def _late(path):
    return Y.late_apart("published", "15 minutes", f"{path}/rows", f"{path}/late", f"{path}/marks")


def _unseen(path):
    return Y.unseen_only("event_id", F.col("published"), f"{path}/rows", f"{path}/seen")


@query("stream_late_entries", f"""
    WITH {_DELIVERED}, marks AS (
        SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING) - INTERVAL 15 minutes AS watermark FROM landed GROUP BY file)
    SELECT event_id, file::BIGINT AS batch_id, CASE WHEN ts < watermark
        THEN 'older than the watermark' END AS reason FROM landed JOIN marks USING (file)""")
def stream_late_entries(spark, sf_dir):
    """Rows on time and late rows, five batches."""
    path = _land_batches(spark, sf_dir, _late)
    rows = Y.left(spark, f"{path}/rows", "event_id long")
    late = Y.left(spark, f"{path}/late", "event_id long, reason string")
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(late).drop("run")


@query("stream_unseen_entries", f"""
    WITH {_DELIVERED} SELECT event_id, 'first' AS run, file::BIGINT AS batch_id FROM landed""")
def stream_unseen_entries(spark, sf_dir):
    """Every entry arrives twice in each of two runs over the same files."""
    path = _land_batches(spark, sf_dir, _unseen, ("first", "second"), times=2)
    return Y.left(spark, f"{path}/rows", "event_id long")


@query("stream_batch_log", f"""
    WITH {_DELIVERED}, n AS (SELECT file, count(*) AS n FROM landed GROUP BY file)
    SELECT run, file::BIGINT AS batch_id, 2 * n AS n_rows, n * (run = 'first')::INT AS n_written,
        2 * n - n * (run = 'first')::INT AS n_repeated, true AS timed
    FROM n, (VALUES ('first'), ('second')) r(run)""")
def stream_batch_log(spark, sf_dir):
    """One row a batch: what came in, what was new, and whether the rate fits the time."""
    path = _land_batches(spark, sf_dir, _unseen, ("first", "second"), times=2)
    log = Y.left(spark, f"{path}/log", "n_rows long, n_written long, n_repeated long, "
                                       "seconds double, rows_per_second double")
    rate = F.col("n_rows") / F.col("seconds")
    return log.select("run", "batch_id", "n_rows", "n_written", "n_repeated", (F.abs(
        F.col("rows_per_second") / rate - 1) < 1e-6).alias("timed"))


_DELIVERED_RUNS = f"""{_DELIVERED},
    g AS (SELECT *, (round((epoch_us(ts) / 1e6 + value * 20) / 900.0) * 900)::BIGINT AS run_id
        FROM landed)"""


def _deliver_files(spark, sf_dir):
    """The statistics after five deliveries, the second one taken twice."""
    path = shared_path(spark, "ledger")
    files = _with_file(table(spark, sf_dir, "events"))
    for number in (0, 1, 1, 2, 3, 4):
        one = files.filter(F.col("file") == number)
        found = entries(one).withColumn("run_id", B.run_bucket(seen()))
        L.deliver(found, f"file-{number}", f"{path}/ledger", f"{path}/statistics",
                  F.col("latency") > 90)
    return L.read_statistics(spark, f"{path}/statistics")


@query("delivered_run_statistics", f"""
    WITH {_DELIVERED_RUNS}, s AS (SELECT DISTINCT run_id, feed FROM g, (SELECT DISTINCT event_type
        AS feed FROM events UNION ALL SELECT 'silent'))
    SELECT s.run_id, feed AS feed_name, count(event_id) AS article_count,
           round(coalesce(avg(value), 0), 6) AS article_avg,
           count(*) FILTER (value > 90) AS failed_count
    FROM s LEFT JOIN g ON g.run_id = s.run_id AND event_type = feed GROUP BY ALL""")
def delivered_run_statistics(spark, sf_dir):
    """Increments add up to the statistics of all entries at once."""
    feeds = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed_name")).distinct()
    catalogue = feeds.unionByName(spark.createDataFrame([("silent",)], "feed_name string"))
    return L.with_silent_feeds(_deliver_files(spark, sf_dir), catalogue).withColumn(
        "article_avg", F.round("article_avg", 6))


@query("run_deliveries", f"""
    WITH {_DELIVERED_RUNS} SELECT run_id, event_type AS feed_name,
        count(DISTINCT file) AS deliveries, 'file-' || max(file) AS last_delivery
    FROM g GROUP BY ALL""")
def run_deliveries(spark, sf_dir):
    """Which delivery changed a run last, and how many did."""
    return _deliver_files(spark, sf_dir).select(
        "run_id", "feed_name", "deliveries", "last_delivery")
