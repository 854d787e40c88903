"""Run histories, schedules and failure locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import beyond


def last_run(workflows: DataFrame, runs: DataFrame, key: str, order: list) -> DataFrame:
    """Each workflow with its newest run; nulls for those that never ran."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    newest = runs.withColumn("__place", place).where("__place = 1").drop("__place")
    return workflows.join(newest, key, "left")


def beyond_newest(runs: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The runs that go when the newest ``keep`` of each workflow stay; ``order`` must leave no ties."""
    return beyond(runs, [key], order, keep)


def run_status(nodes: DataFrame, run: str) -> DataFrame:
    """cancelled, then error (a failed node that stops), then partial (any other failure), then ok."""
    failed = F.col("status") == "error"
    return nodes.groupBy(run).agg(
        F.when(F.bool_or(F.col("status") == "cancelled"), "cancelled")
        .when(F.bool_or(failed & (F.col("on_error") == "stop")), "error")
        .when(F.bool_or(failed), "partial")
        .otherwise("ok")
        .alias("estado")
    )


def interrupted(status: Column) -> Column:
    return F.when(status.isin("running", "queued"), "error").otherwise(status)


def overlaps(runs: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """Runs that begin before an earlier one of their workflow has ended."""
    before = Window.partitionBy(key).orderBy(start, order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("__until", F.max(end).over(before)).where(F.col(start) < F.col("__until")).drop("__until")


def capped_result(value: Column, most: int) -> Column:
    size = F.octet_length(value)
    return F.when(size > most, F.to_json(F.struct(F.lit(True).alias("truncado"), size.alias("bytes")))).otherwise(value)


def next_fire(after: Column, hour: int, minute: int, days: list[int]) -> Column:
    """The next instant at this time on one of the weekdays (0 is Monday), strictly after ``after``."""
    day = F.date_trunc("day", after)
    at = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: day + F.make_dt_interval(i, F.lit(hour), F.lit(minute), F.lit(0).cast("decimal(18,6)")))
    return F.array_min(F.filter(at, lambda t: (t > after) & F.weekday(t).isin(*days)))


def locked_out(events: DataFrame, keys: list[str], ts: str, order: str, failed: Column, most: int = 5, window: int = 300) -> DataFrame:
    """``bloqueado``: whether ``most`` failures since the last success lie in the ``window`` seconds up to here."""
    session = Window.partitionBy(*keys).orderBy(ts, order)
    micros = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__failed", failed.cast("long"))
    split = micros.withColumn("__session", F.sum(1 - F.col("__failed")).over(session.rowsBetween(Window.unboundedPreceding, 0)))
    recent = Window.partitionBy(*keys, "__session").orderBy("__us").rangeBetween(-(window * 1_000_000 - 1), 0)
    out = split.withColumn("fallos", F.sum("__failed").over(recent))
    return out.withColumn("bloqueado", F.col("fallos") >= most).drop("__us", "__failed", "__session")


def idle_sessions(events: DataFrame, keys: list[str], ts: str, idle: int, longest: int) -> DataFrame:
    """Sessions that end after ``idle`` seconds without an event; ``vigente`` if none lasts beyond ``longest``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = events.withColumn("__us", seconds)
    fresh = F.coalesce((F.col("__us") - F.lag("__us").over(w) >= idle * 1_000_000).cast("long"), F.lit(0))
    numbered = gaps.withColumn("__new", fresh).withColumn("sesion", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "sesion").agg(
        F.count(F.lit(1)).alias("eventos"), ((F.max("__us") - F.min("__us")) <= longest * 1_000_000).alias("vigente")
    )


def latest_ok_results(runs: DataFrame, results: DataFrame, workflow: str, order: list, newest: int = 20) -> DataFrame:
    """The newest ``ok`` result of each node among the last finished runs of each workflow."""
    recent = runs.withColumn("nth", F.row_number().over(Window.partitionBy(workflow).orderBy(*order))).where(F.col("nth") <= newest)
    met = results.where("status = 'ok'").join(recent.select("run_id", workflow, "nth"), "run_id")
    newer = F.row_number().over(Window.partitionBy(workflow, "node_id").orderBy("nth"))
    return met.withColumn("place", newer).where("place = 1").drop("place", "nth")


#: Names of the days.
DAYS = ["Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom"]


def described(kind: Column, time: Column, days: Column, every_minutes: Column) -> Column:
    """A schedule in words: ``Lun–Vie a las 07:30``, ``Lun, Mié a las 07:30``, ``Todos los días a las 07:30``, ``Cada 3 h``, ``Cada 45 min``.

    ``days``: a list of numbers with commas, 0 being Monday; none is every day.
    """
    given = F.filter(F.split(F.coalesce(days, F.lit("")), ","), lambda d: d != "")
    names = F.transform(given, lambda d: F.element_at(F.array(*map(F.lit, DAYS)), d.cast("int") + 1))
    listed = F.array_join(given, ",")
    which = F.when(listed.isin("", "0,1,2,3,4,5,6"), "Todos los días").when(listed == "0,1,2,3,4", "Lun–Vie").otherwise(F.array_join(names, ", "))
    hours = F.regexp_replace(F.round(every_minutes / 60, 3).cast("string"), "[.]0*$", "")
    often = F.when(every_minutes < 120, F.format_string("Cada %d min", every_minutes)).otherwise(F.concat(F.lit("Cada "), hours, F.lit(" h")))
    return F.when(kind == "interval", often).otherwise(F.concat(which, F.lit(" a las "), time))
