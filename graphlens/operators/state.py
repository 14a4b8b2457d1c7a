"""State that builds up over ordered rows: rate limits, session memories, tasks and metrics, as set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators.lookup import first_of
from graphlens.operators.positions import carried, nearest_rank, positioned, sessions

TERMINAL = ("success", "failed")


def rate_limited(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", limit: int = C.RATE_LIMIT, window_s: int = C.RATE_WINDOW_S) -> DataFrame:
    """key, windows, accepted, rejected: a window begins with the first request after the last one ended; in it `limit`
    requests are accepted, later ones are rejected but counted.

    Requests apart by a whole window or more always begin a new one, so that stretches between such gaps go to tasks of their
    own. A stretch is sorted and streamed: memory holds one batch and one window's begin and count, and the work is one search per
    window, not per request."""
    parts = sessions(events.select(key, at, tie), key, at, tie, window_s).select(key, "session", F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    kind = events.schema[key].dataType.simpleString()
    span = window_s * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begin, n, out = None, 0, 0, []
        for b in batches:
            us = b["us"].to_numpy()
            owner = list(zip(b[key], b["session"]))
            edges = [i for i in range(len(owner)) if i == 0 or owner[i] != owner[i - 1]] + [len(owner)]
            for lo, hi in zip(edges, edges[1:]):
                fresh = owner[lo] != now
                now = owner[lo]
                windows = rejected = 0
                i = lo
                while i < hi:
                    if fresh or us[i] >= begin + span:
                        begin, n, windows, fresh = us[i], 0, windows + 1, False
                    j = i + int(np.searchsorted(us[i:hi], begin + span))
                    rejected += max(0, n + j - i - limit) - max(0, n - limit)
                    n, i = n + j - i, j
                out.append((now[0], windows, hi - lo - rejected, rejected))
            yield pd.DataFrame(out, columns=[key, "windows", "accepted", "rejected"])
            out = []

    told = parts.repartition(key, "session").sortWithinPartitions(key, "session", "us").mapInPandas(fold, f"{key} {kind}, windows long, accepted long, rejected long")
    return told.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("windows", "accepted", "rejected")])


def session_spans(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", ttl_s: float = C.SESSION_TTL_S) -> DataFrame:
    """key, session, n, first, last: a memory that every event refreshes is lost after ttl_s seconds without one."""
    s = sessions(events.select(key, at, tie), key, at, tie, ttl_s)
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def anchors_kept(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`turns` (level, confidence, target) with what the session's anchor is after each: `kept_target`, and `cleared` where the
    target changed. A strong anchor is not overwritten by one of level none; a weak one is (and null from there on)."""
    real = F.when(F.col("level") != "none", F.struct("target", "confidence"))
    x = carried(turns.withColumn("_real", real), [key], order, "_real", "_before")
    last = F.coalesce("_real", "_before")
    kept = F.when(F.col("level") != "none", F.col("target")).when(last["confidence"] >= C.ANCHOR_STRONG, last["target"])
    x = x.withColumn("kept_target", kept).withColumn("_kept", F.struct("kept_target"))
    x = carried(x, [key], order, "_kept", "_was")
    was = F.col("_was")["kept_target"]
    return x.withColumn("cleared", was.isNotNull() & F.col("kept_target").isNotNull() & (was != F.col("kept_target"))).drop("_real", "_before", "_kept", "_was")


def keyed_fold(rows: DataFrame, key: str, order: list[str], first: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], columns: list[str], schema: str) -> DataFrame:
    """One output row per row, from a state that goes along each key in order. For folds that no window expresses: rows
    are sorted within partitions and streamed, so that memory holds one state, not a key's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for k, *values in b[[key, *columns]].itertuples(index=False, name=None):
                if k != now:
                    now, state = k, first()
                state, told = step(state, tuple(values))
                out.append((k, *told))
            yield pd.DataFrame(out, columns=names)

    placed = rows.filter(F.col(key).isNotNull()).select(key, *dict.fromkeys([*order, *columns])).repartition(key).sortWithinPartitions(key, *order)
    return placed.mapInPandas(run, schema)


def _continues(now: str, new: str) -> bool:
    if now in new or new in now:
        return True
    a, b = set(now.split()), set(new.split())
    if a and b:
        return bool(a & b)
    x, y = set(now) - {" "}, set(new) - {" "}
    return bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.5


def focus_memory(turns: DataFrame, key: str, order: list[str], question: str, row: str) -> DataFrame:
    """key, row, focus: the focus after each question; it stays while questions go on from it, else the question (normalised)
    becomes the focus. Blank questions change nothing."""
    asked = turns.withColumn("_q", X.normalised(F.col(question)))

    def step(focus: str, values: tuple) -> tuple[str, tuple]:
        which, q = values
        if q and (not focus or not _continues(focus, q)):
            focus = q
        return focus, (which, focus)

    return keyed_fold(asked, key, order, str, step, [row, "_q"], f"{key} string, {row} long, focus string")


def latest_tasks(log: DataFrame) -> DataFrame:
    """task_id, status, created_at, updated_at from a log (task_id, status, at, seq): the last entry counts."""
    return log.groupBy("task_id").agg(F.max(F.struct("at", "seq", "status")).alias("m"), F.min("at").alias("created_at")).select("task_id", "m.status", "created_at", F.col("m.at").alias("updated_at"))


def retained(tasks: DataFrame, now, retention_s: int, most: int) -> DataFrame:
    """Tasks without ended ones that were last updated before now - retention_s, then without the oldest ended ones beyond
    `most` tasks in all. Running tasks always stay."""
    ended = F.col("status").isin(*TERMINAL)
    kept = tasks.filter(~(ended & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(retention_s)))))
    over = max(kept.count() - most, 0)
    numbered = positioned(kept.filter(ended), [], ["updated_at", "task_id"])
    return kept.filter(~ended).unionByName(numbered.filter(F.col("position") > over).drop("position"))


def task_progress(log: DataFrame) -> DataFrame:
    """task_id, sections, done, failed, status: the last status of each section decides: completed when all are done, failed when
    any failed, else in progress. log: task_id, section, status (pending, done, failed), at, seq."""
    last = log.groupBy("task_id", "section").agg(F.max(F.struct("at", "seq", "status")).alias("m")).select("task_id", "section", "m.status")
    told = last.groupBy("task_id").agg(F.count("*").alias("sections"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    status = F.when(F.col("done") == F.col("sections"), "completed").when(F.col("failed") > 0, "failed").otherwise("in_progress")
    return told.withColumn("status", status)


def retries_exhausted(log: DataFrame, most: int = C.MAX_RETRIES) -> DataFrame:
    """task_id, section, seq: the retry with which a section failed for good (the one after `most`)."""
    return first_of(log, ["task_id", "section"], ["at", "seq"], most + 1, "_n").filter(F.col("_n") == most + 1).select("task_id", "section", "seq")


def to_resume(planned: DataFrame, progress: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned sections (task_id, section) that are not both done and checkpointed."""
    done = progress.filter(F.col("status") == "done").join(checkpoints, ["task_id", "section"], "left_semi")
    return planned.join(done, ["task_id", "section"], "left_anti")


def histogram_stats(values: DataFrame, name: str, value: str) -> DataFrame:
    """name, min, max, avg, count, p50, p99 (nearest rank)."""
    told = values.filter(F.col(value).isNotNull()).groupBy(name).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.count("*").alias("count"))
    return told.join(nearest_rank(values, name, value, {"p50": 0.5, "p99": 0.99}), name)


def exposition(counters: DataFrame, stats: DataFrame) -> DataFrame:
    """metric, text: counters (name, value) and histograms (name, count, sum, p50, p99) as exposition lines."""
    n = X.metric_name(F.col("name"))
    c = counters.select(n.alias("metric"), F.concat(F.lit("# TYPE "), n, F.lit(" counter\n"), n, F.lit(" "), F.col("value").cast("string")).alias("text"))
    lines = F.concat(
        F.lit("# TYPE "), n, F.lit(" summary\n"), n, F.lit("_count "), F.col("count").cast("string"), F.lit("\n"), n, F.lit("_sum "), F.col("sum").cast("string"), F.lit("\n"),
        n, F.lit('{quantile="0.5"} '), F.col("p50").cast("string"), F.lit("\n"), n, F.lit('{quantile="0.99"} '), F.col("p99").cast("string"),
    )
    return c.unionByName(stats.select(n.alias("metric"), lines.alias("text")))
