"""Spans and feedback state, batch and streaming."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def close_spans(events: DataFrame, opens: str = "signup", closes: Sequence[str] = ("purchase",), fails: Sequence[str] = ("error",)) -> DataFrame:
    """K1, batch: (span_id, user_id, start, end_id, end, duration_ms, status, parent_id) of each opening event.

    Spans nest: events of a user are read by time, then id; an ending closes the innermost
    span that is open (none: it counts for nothing), and a span's parent is the innermost one
    open where it begins.  A span without an end has status ``unclosed``.

    No stack is kept: the running sum of openings less endings, lifted by its own running
    minimum below zero, is the depth.  At one depth openings and endings alternate, so an
    opening's end is the next row of its depth, and its parent the latest opening one depth up.
    """
    opening = F.col("event_type") == opens
    used = events.filter(opening | F.col("event_type").isin(*closes, *fails)).select("user_id", "event_id", "ts", opening.alias("opening"), F.col("event_type").isin(*fails).alias("failed"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = used.withColumn("sum", F.sum(F.when(F.col("opening"), 1).otherwise(-1)).over(run)).withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(run)))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0))).filter("opening OR before > 0").withColumn("level", F.greatest("before", "after"))
    # an opening is a row of its own depth and a possible parent one depth down
    keyed = rows.withColumn("key", F.explode(F.when(F.col("opening"), F.array(F.col("level"), F.col("level") + 1)).otherwise(F.array("level")))).withColumn("own", F.col("key") == F.col("level"))
    at, back = (Window.partitionBy("user_id", "key").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (("ts", "event_id"), (F.desc("ts"), F.desc("event_id"))))
    parent = F.last(F.when(~F.col("own"), F.col("event_id")), ignorenulls=True).over(at)
    following = F.last(F.when(F.col("own"), F.struct("event_id", "ts", "failed")), ignorenulls=True).over(back)
    spans = keyed.withColumns({"parent_id": parent, "end": following}).filter("opening AND own")
    status = F.when(F.col("end").isNull(), "unclosed").when(F.col("end.failed"), "fail").otherwise("ok")
    return spans.select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("start"), F.col("end.event_id").alias("end_id"), F.col("end.ts").alias("end"), F.floor((F.unix_micros(F.col("end.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000).alias("duration_ms"), status.alias("status"), "parent_id")


NESTED = "user_id long, span_id long, parent_id long, start timestamp, end_id long, end timestamp, duration_ms long, status string"


def stream_spans(events: DataFrame, opens: str = "signup", closes: Sequence[str] = ("purchase",), fails: Sequence[str] = ("error",), delay: str = "10 minutes", longest_ms: int = 3_600_000) -> DataFrame:
    """K1, streaming: the spans of ``close_spans``, each as soon as it is sure.

    The state of a user is the open spans and the events above the watermark.  Events wait
    until the watermark (``delay`` behind the latest) passes them, then go by time and id;
    a span still open ``longest_ms`` after its start comes out as ``unclosed``, on a timer
    where no further event of the user arrives.
    """

    def assemble(key, batches, state):
        (user,) = key
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "open": []}
        for pdf in batches:
            ts = pdf["ts"].astype("datetime64[us]").astype("int64")
            held["wait"] += [list(x) for x in zip(ts.tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist())]
        now = state.getCurrentWatermarkMs() * 1000
        out = []

        def leave(span, end_id=None, end=None, status="unclosed"):
            start, span_id, parent = span
            out.append((user, span_id, parent, start, end_id, end, None if end is None else (end - start) // 1000, status))

        held["wait"].sort()
        ready = [x for x in held["wait"] if x[0] <= now]
        held["wait"] = held["wait"][len(ready) :]
        for ts, event_id, kind in ready:
            if kind == opens:
                held["open"].append([ts, event_id, held["open"][-1][1] if held["open"] else None])
            elif held["open"]:
                leave(held["open"].pop(), event_id, ts, "fail" if kind in fails else "ok")
        if not held["wait"]:
            for span in held["open"]:
                if span[0] + longest_ms * 1000 <= now:
                    leave(span)
            held["open"] = [s for s in held["open"] if s[0] + longest_ms * 1000 > now]
        if held["wait"] or held["open"]:
            state.update((json.dumps(held),))
            due = min(x[0] for x in held["wait"]) if held["wait"] else min(s[0] for s in held["open"]) + longest_ms * 1000
            state.setTimeoutTimestamp(max(due // 1000, now // 1000) + 1)
        else:
            state.remove()
        columns = ["user_id", "span_id", "parent_id", "start", "end_id", "end", "duration_ms", "status"]
        pdf = pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns if c not in ("start", "end", "status")})
        yield pdf.assign(start=pd.to_datetime(pdf["start"], unit="us"), end=pd.to_datetime(pdf["end"], unit="us"))

    used = events.filter(F.col("event_type").isin(opens, *closes, *fails)).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return used.groupBy("user_id").applyInPandasWithState(assemble, NESTED, "held string", "append", "EventTimeTimeout")


def assemble_spans(events: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """K1, streaming or batch, of trace events (span_id, kind start/end/error, ts, name): one row a closed span.

    The watermark and the longest span (``timeout``) are ours: a span that isn't closed
    within it stays out.
    """
    start = events.filter("kind = 'start'").select("span_id", "name", F.col("ts").alias("start_ts"))
    end = events.filter("kind IN ('end', 'error')").select(F.col("span_id").alias("end_span"), F.col("ts").alias("end_ts"), F.when(F.col("kind") == "error", "fail").otherwise("ok").alias("status"))
    if events.isStreaming:
        start, end = start.withWatermark("start_ts", timeout), end.withWatermark("end_ts", timeout)
    on = (F.col("span_id") == F.col("end_span")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {timeout}"))
    return start.join(end, on).select("span_id", "name", "start_ts", "end_ts", "status", (F.unix_millis("end_ts") - F.unix_millis("start_ts")).alias("duration_ms"))


def feedback_state(events: DataFrame) -> DataFrame:
    """K2: current status of each (app, unit) and its number of events."""
    return events.groupBy("app_id", "unit").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.count("*").alias("events"))


def mark_stale(feedback: DataFrame, changed: DataFrame) -> DataFrame:
    """K2: ``feedback`` with status ``stale`` for the open rows of units in ``changed(app_id, unit)``, and whether a row changed.

    Content never changes; applied, closed and stale rows stay as they are.
    """
    units = changed.select("app_id", "unit").distinct().withColumn("_hit", F.lit(True))
    out = feedback.join(units.hint("merge"), ["app_id", "unit"], "left").withColumn("changed", F.coalesce(F.col("_hit") & (F.col("status") == "open"), F.lit(False)))
    return out.withColumn("status", F.when(F.col("changed"), "stale").otherwise(F.col("status"))).select(*feedback.columns, "changed")


def set_status(feedback: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """K2: the rows named in ``ids(id)`` take the status, and whether a row changed."""
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = feedback.join(named.hint("merge"), "id", "left").withColumn("changed", F.coalesce(F.col("_hit") & (F.col("status") != status), F.lit(False)))
    return out.withColumn("status", F.when(F.col("changed"), status).otherwise(F.col("status"))).select(*feedback.columns, "changed")
