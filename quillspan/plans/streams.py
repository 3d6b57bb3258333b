"""Queries over streams that are run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines
from ..sources import tables as S
from ..sources.scratch import new_path
from ..streaming import claims, keyed
from ..streaming import streams as X
from .kit import Plans

P = Plans()


@P.query("queue_stream", "SELECT page_id, url, CASE WHEN length(html) > 0 THEN 'completed' ELSE 'failed' END AS status FROM pages")
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    return X.drained(X.processed_queue(X.stream_of(spark, d, "pages")), "queue").drop("__batch")


@P.query("conversation_state", "SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, max_by(role, turn * 10 + CASE role WHEN 'user' THEN 3 WHEN 'system' THEN 2 ELSE 1 END) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """The last update of each conversation: one for each micro-batch that had a turn of it."""
    out = X.drained(X.conversation_states(X.stream_of(spark, d, "conversations")), "conversations", "update")
    rest = ["n_turns", "last_turn", "last_role", "chars"]
    last = out.groupBy("conv_id").agg(F.max(F.struct("__batch", *rest)).alias("s"))
    return last.select("conv_id", *[F.col(f"s.{c}").alias(c) for c in rest])


@P.query("telemetry_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def telemetry_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows of the whole table, as a batch: what the stream emits once its watermark has passed."""
    w = X.windowed_telemetry(S.read(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n", F.round("total", 6).alias("total"))


_HITS = "SELECT r.event_id, max(e.ts) AS entry_ts, count(*) AS n FROM events r JOIN events e ON e.user_id = r.user_id AND e.event_type = 'purchase' AND e.ts <= r.ts AND e.ts >= r.ts - INTERVAL 6 HOUR WHERE r.event_type = 'view' GROUP BY r.event_id"


@P.query("cache_ttl_stream", f"SELECT event_id, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry, n FROM ({_HITS})")
def cache_ttl_stream(spark: SparkSession, d: str) -> DataFrame:
    """Views of a user that a purchase of at most six hours before answers, as two streams; the newest entry of each."""
    rows = lambda kind: X.stream_of(spark, d, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("at"))
    hits = X.drained(keyed.cache_hits(rows("view"), rows("purchase"), ["user_id"], "6 HOURS", "31 days"), "hits")
    best = hits.groupBy(F.col("request.id").alias("event_id")).agg(F.max("entry.at").alias("entry"), F.count(F.lit(1)).alias("n"))
    return best.select("event_id", F.date_format("entry", "yyyy-MM-dd HH:mm:ss").alias("entry"), "n")


@P.query("stage_upsert_stream", "SELECT user_id, event_type, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type")
def stage_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user and type, upserted batch by batch of a stream."""
    path = new_path(spark, "stages")
    events = X.stream_of(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    table = keyed.StageTable(spark, path, ["user_id", "event_type"], "ts", "user_id long, event_type string, event_id long, ts timestamp")
    X.each_batch(events, path, table.write)
    return table.read().select("user_id", "event_type", "event_id")


@P.query("ndjson_epochs", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def ndjson_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed out as lines of JSON, epoch by epoch, and the committed ones read back."""
    path = new_path(spark, "lines")
    spark.dataSource.register(lines.Lines)
    events = X.stream_of(spark, d, "events").select("event_id", "event_type")
    events.writeStream.format("lines").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    back = lines.committed(spark, path).select(F.from_json("value", "event_id long, event_type string").alias("e")).select("e.*")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@P.query("queue_claims", "SELECT page_id, CASE WHEN length(html) > 0 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT page_id, any_value(html) AS html FROM pages GROUP BY page_id)")
def queue_claims(spark: SparkSession, d: str) -> DataFrame:
    """Two workers with leases on halves of the queue: together they do each of its rows once."""
    path, result = new_path(spark, "claims"), "page_id long, status string"
    queue = lambda: S.read(spark, d, "pages")
    work = lambda rows: X.processed_queue(rows).select("page_id", "status")
    both = [claims.Worker(spark, path, name, "page_id", work, queue, result, buckets=16, most=8, seconds=3600) for name in ("first", "second")]
    for w in both:
        X.each_batch(X.stream_of(spark, d, "pages"), f"{path}-{w.name}", w)
    return both[0].done()
