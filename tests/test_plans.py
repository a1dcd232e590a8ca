"""What a query sends to all machines, and how often it reads its table, from the plans of all that it writes."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tidewatch.operators import features as W
from tidewatch.plans.registry import QUERIES
from tidewatch.session import written

SMALL = "/root/testdata/sf0.001"
#: Tables with rows for each window of each session. Their long runs make small files.
BY_WINDOW = r"/(movement|states|window-counts|smoothed-windows|contribution-windows|contribution-steps|timeline)-"


def sent_by_window(plan: str) -> list[str]:
    """Windows under a broadcast with no exchange, aggregate or join between."""
    lines, found = plan.splitlines(), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if "Generate explode(sequence" in below or re.search(BY_WINDOW, below):
                    found.append(below)
                if not re.search(r"(Project|Filter|Generate|ColumnarToRow) ?", below):
                    break
    return found


def plans(spark, monkeypatch, name: str) -> list[str]:
    seen, write = [], DataFrameWriter.parquet

    def noted(self, *a, **k):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    out = QUERIES[name](spark, SMALL)
    return [*seen, out._jdf.queryExecution().executedPlan().toString()]


#: How often a query scans the events: once for its sessions, once or twice for its series, once for its segments, and for fingerprints.
SCANS = {"contribution": 4, "manifest_json": 6, "manifest_problems": 6, "weighted_combine": 4, "render_plan": 4, "detect_events": 4, "hysteresis": 3, "mapped_values": 3, "merge_events": 4, "missing_fraction": 3, "movement_events": 4, "normalize_span": 3, "rate_limit": 3, "restless_windows": 4, "topk_pinned": 4, "window_smooth_mid": 3}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_windows_stay_where_they_are(spark, monkeypatch, name):
    every = plans(spark, monkeypatch, name)
    assert not [x for p in every for x in sent_by_window(p)]
    assert sum(len(re.findall(r"FileScan parquet [^\n]*/events\.parquet", p)) for p in every) <= SCANS[name]


def test_joins_with_windows_sort(spark):
    s = spark.createDataFrame([("a", 0, 3_600_000_000)], "session_id string, start_us bigint, end_us bigint")
    other = s.select("session_id", F.lit(0).alias("w"), F.lit("x").alias("x"))
    plan = W.windows(s, 180).withColumn("y", F.col("w") + 1).join(other, ["session_id", "w"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_what_is_written_is_not_written_again(spark):
    a = written(spark.range(3), "once")
    assert written(a, "twice") is a and written(a.filter("id > 0"), "part").count() == 2
