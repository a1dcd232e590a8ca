"""Streaming forms of two operators: grid buckets with a watermark, and hysteresis with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_means(stream: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(session_id, metric, us, value, n) of points (session_id, metric, ts, value) per bucket; points later than the watermark are left out."""
    per = stream.withWatermark("ts", late).groupBy("session_id", "metric", F.window("ts", width)).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return per.select("session_id", "metric", F.unix_micros("window.start").alias("us"), "value", "n")


def level_changes(stream: DataFrame, threshold: float) -> DataFrame:
    """(session_id, metric, us, value) where the value is ``threshold`` away from the one reported last; the state is that one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for us, v in sorted(x for b in batches for x in zip(b["us"], b["value"], strict=True)):
            if last is None or abs(v - last) >= threshold:
                last = v
                out.append((*key, us, v))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "metric", "us", "value"])

    shape = "session_id string, metric string, us bigint, value double"
    return stream.groupBy("session_id", "metric").applyInPandasWithState(step, shape, "last double", "append", GroupStateTimeout.NoTimeout)
