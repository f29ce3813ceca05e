"""File events: merging by path, routing, delays and per-user queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: The kinds of events.
KINDS = ("Added", "Removed", "Modified", "RenamedOld", "RenamedNew")


def merge(old: Column, new: Column) -> Column:
    """What two events of one path in a row amount to.

    A removal or leaving name counts at once; an arriving name is an addition; a removed path
    stays removed; a change to an added file leaves it added; otherwise the later counts.
    """
    later = F.when(new == "RenamedNew", "Added").otherwise(new)
    return (
        F.when(new.isin("Removed", "RenamedOld"), new)
        .when(old == "Removed", old)
        .when((old == "Added") & (later == "Modified"), old)
        .otherwise(later)
    )


def merge_python(old: str, new: str) -> str:
    """``merge`` for one pair of plain values (streaming state)."""
    if new in ("Removed", "RenamedOld"):
        return new
    later = "Added" if new == "RenamedNew" else new
    return old if old == "Removed" or (old, later) == ("Added", "Modified") else later


def merge_events(events: DataFrame, period: str = "7 seconds") -> DataFrame:
    """(path, start, event, n): events (path, ts, seq, event) of each flush period merged in order of
    seq.  A path's first event is taken as it stands."""
    keyed = events.select("path", F.window("ts", period).getField("start").alias("start"), "seq", "event")
    lists = keyed.groupBy("path", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("l"))
    first = F.get("l", F.lit(0))["event"]
    rest = F.slice("l", F.lit(2), F.size("l"))
    return lists.select("path", "start", F.aggregate(rest, first, lambda acc, x: merge(acc, x["event"])).alias("event"), F.size("l").alias("n"))


def route_events(events: DataFrame) -> DataFrame:
    """Events with their route: removal, drop, header rewrite, or index and registry."""
    removal = F.col("event").isin("Removed", "RenamedOld")
    return events.withColumn("route", F.when(removal, "remove").otherwise(T.routed(F.col("path"))))


def delayed_due(events: DataFrame, now: Column, delay: str = "7 seconds", again: str = "5 seconds", attempts: int = 20) -> DataFrame:
    """Delayed actions (ts, tries, ready) at a moment: ``run`` when due, ``wait`` while not, ``later``
    with a new time when due but not ready, ``failed`` after all attempts."""
    due = F.col("ts") + F.expr(f"interval {delay}")
    state = F.when(F.col("tries") >= attempts, "failed").when(due > now, "wait").when(~F.col("ready"), "later").otherwise("run")
    return events.withColumn("state", state).withColumn("due", F.when(state == "later", now + F.expr(f"interval {again}")).otherwise(due))


def tick(events: DataFrame, now: Column, delay: str = "7 seconds") -> DataFrame:
    """(.., state) for one queue tick: the first action that is not due goes to the back and ends
    the tick; those before it run, those behind it stay."""
    due = F.col("ts") + F.expr(f"interval {delay}")
    stop = events.where(due > now).agg(F.min("seq").alias("stop"))
    joined = events.crossJoin(F.broadcast(stop))  # one row
    return joined.withColumn("state", F.when(F.col("stop").isNull() | (F.col("seq") < F.col("stop")), "run").when(F.col("seq") == F.col("stop"), "back").otherwise("stay")).drop("stop")


def fifo(messages: DataFrame, user: str, seq: str) -> DataFrame:
    """Messages with their place (from 1) in their user's queue."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(seq)))


def take_next(messages: DataFrame, user: str, seq: str) -> DataFrame:
    """Each user's oldest message."""
    head = messages.groupBy(user).agg(F.min(seq).alias(seq))
    return messages.join(head, [user, seq])
