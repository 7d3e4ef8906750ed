"""Queries: finite replay of the event files through the streaming monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.plans.registry import query, shape
from cashlens.sources.staging import fresh_path
from cashlens.streaming import monitor

SPECS = {"monitor_stream": "user_id T n:i total:4 active_days:i",
         "monitor_alerts": "user_id T n:i score:6 health_smooth:4 trajectory alert"}


@query("monitor_stream")
def _monitor(t):
    src = t.source("events").schema
    stream = (t.spark.readStream.schema(src).option("pathGlobFilter", "events.parquet").parquet(t.dir)
              .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value"))
    out, ckpt = fresh_path(t.spark, "daily"), fresh_path(t.spark, "stream")
    monitor.run(stream, "user_id", "ts", "value", out, ckpt)
    return shape(monitor.monthly(monitor.daily(t.spark, out, "user_id"), "user_id"), SPECS["monitor_stream"])


@query("monitor_alerts")
def _alerts(t):
    """The events as six arrivals, each of some hours of every day; alerts follow each arrival for the users in it."""
    src, out, ckpt = (fresh_path(t.spark, n) for n in ("arrivals", "monitor", "stream"))
    e = t.source("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    part = F.pmod(F.hour("ts"), F.lit(6))
    for i in range(6):
        e.where(part == i).write.parquet(f"{src}/arrival={i}")
        stream = t.spark.readStream.schema(e.schema).parquet(f"{src}/arrival=*").select(*e.columns)
        monitor.run(stream, "user_id", "ts", "value", out, ckpt, lambda m: monitor.activity_alerts(m, "user_id", t.cfg), fan_out=3)
    return shape(monitor.current_alerts(t.spark, out, "user_id"), SPECS["monitor_alerts"])
