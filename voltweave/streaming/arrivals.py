"""Spike events as a stream: what each sends to its targets, by event-time window.

An extension of the batch scatter for spikes that arrive late or out of order. The edges are a static
table; late events are taken up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arriving_current(spikes: DataFrame, edges: DataFrame, *, step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """spikes: a stream of id and ts. Per target and window of one step: the sum of weights that arrive in it. An edge of delay d adds d steps to the event's time."""
    shifted = (F.unix_micros("ts") + F.col("delay") * F.expr(f"unix_micros(timestamp'1970-01-01' + interval {step}) - unix_micros(timestamp'1970-01-01')")).alias("at")
    met = spikes.withWatermark("ts", late).join(edges.select(F.col("source").alias("id"), "target", "weight", "delay"), "id")
    sent = met.select("target", "weight", F.window("ts", step).alias("emitted"), shifted)
    out = sent.groupBy("emitted", "target", F.timestamp_micros("at").alias("arrive_ts")).agg(F.sum(F.col("weight").cast("long")).alias("current"), F.count(F.lit(1)).alias("n_spikes"))
    return out.select("target", F.col("emitted.start").alias("emitted_from"), "arrive_ts", "current", "n_spikes")
