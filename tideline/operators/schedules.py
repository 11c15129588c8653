"""Fire times of five-field schedules (minute, hour, day, month, weekday with Sunday 0 or 7) in a time zone, without a clock of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the least and greatest of each field
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
#: Hours of past slots in a plan, and minutes after which a slot that did not fire was missed.
PAST, GRACE = 24, 10
#: Slots of a schedule in a plan, a feature of plans.
SLOTS = 200


def _numbered(part: str) -> str:
    """A field with names of months or days as numbers."""
    names = {name: i + 1 for i, name in enumerate(MONTHS)} | {name: i for i, name in enumerate(DAYS)}
    return re.sub(r"[A-Za-z]+", lambda m: str(names.get(m[0].upper(), -1)), part)


def fields(expression: str) -> list[list[int] | None]:
    """The values of each field, None for all: lists, ranges and steps of numbers."""
    out: list[list[int] | None] = []
    parts = expression.split()
    if len(parts) != len(BOUNDS):
        raise ValueError(f"a schedule has {len(BOUNDS)} fields: {expression}")
    for part, (least, most) in zip(parts, BOUNDS, strict=True):
        if part == "*":
            out.append(None)
            continue
        found: set[int] = set()
        for x in _numbered(part).split(","):
            span, _, step = x.partition("/")
            first, _, last = span.partition("-")
            a, b = (least, most) if span == "*" else (int(first), int(last or (most if step else first)))
            if not least <= a <= b <= most or step and int(step) < 1:
                raise ValueError(f"not a field of a schedule: {part}")
            found.update(range(a, b + 1, int(step or 1)))
        out.append(sorted(found))
    if out[4] is not None:
        out[4] = sorted({d % 7 for d in out[4]})
    return out


def _day(local: Column, at: list[list[int] | None]) -> Column:
    """Whether a day fires; if both days of the month and of the week are given, either does."""
    day = F.dayofmonth(local).isin(at[2]) if at[2] else None
    week = (F.dayofweek(local) - 1).isin(at[4]) if at[4] is not None else None
    month = F.month(local).isin(at[3]) if at[3] else F.lit(True)
    if day is not None and week is not None:
        return month & (day | week)
    return month & (day if day is not None else week if week is not None else F.lit(True))


def _minutes(at: list[list[int] | None]) -> list[int]:
    """Minutes of a day at which a schedule fires."""
    return [60 * h + m for h in at[1] or range(24) for m in at[0] or range(60)]


def _times(at: list[list[int] | None]) -> Column:
    return F.array(*map(F.lit, _minutes(at)))


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def local_time(at: Column, zone: str) -> Column:
    """The clock of a zone at an instant, without a zone; the session's own zone plays no part."""
    seconds = F.unix_micros(at).cast("decimal(24,0)") / F.lit(1000000).cast("decimal(7,0)")
    utc = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant(local: Column, zone: str) -> Column:
    """The instant at which a zone's clock shows a time; one that is left out by the clock counts from before the change."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), utc))


def _day_fires(start: Column, days: int, expression: str, zone: str, most: int | None = None, last: bool = False) -> Column:
    """Times of the schedule from a date on, for so many days more; of the first (or last) `most` days that fire only."""
    at = fields(expression)
    dates = F.filter(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda i: F.date_add(start, i)), lambda d: _day(d, at))
    if most:
        dates = F.slice(dates, F.greatest(F.size(dates) - most + 1, F.lit(1)) if last else F.lit(1), F.lit(most))
    local = F.flatten(F.transform(dates, lambda d: F.transform(_times(at), lambda m: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), m))))
    return F.transform(local, lambda t: instant(t, zone))


def _fires(first: Column, days: int, expression: str, zone: str, most: int | None = None, last: bool = False) -> Column:
    """The same from the day of an instant on."""
    return _day_fires(local_time(first, zone).cast("date"), days, expression, zone, most, last)


def _with_fires(df: DataFrame, name: str, first: Column, days: int, expression: str, zone: str, most: int, last: bool = False) -> DataFrame:
    """df with _fires() of each row in a column `name`: made once for each date that the rows begin at (a calendar's worth of them), and joined."""
    rows = df.withColumn("_start", local_time(first, zone).cast("date"))
    dates = rows.select("_start").distinct().select("_start", _day_fires(F.col("_start"), days, expression, zone, most, last).alias(name))
    return rows.join(F.broadcast(dates), "_start", "left").drop("_start")


def upcoming(at: Column, expression: str, zone: str = "UTC", days: int = 366) -> Column:
    """The first fire after a time; null if there is none within `days`. Of three days that fire one has it."""
    return _first_after(_fires(at, days, expression, zone, 3), at)


def previous(at: Column, expression: str, zone: str = "UTC", days: int = 366) -> Column:
    """The last fire at or before a time; null if there is none within `days`."""
    return _last_until(_fires(at - F.make_dt_interval(F.lit(days)), days, expression, zone, 3, True), at)


def _first_after(fires: Column, at: Column) -> Column:
    return F.array_min(F.filter(fires, lambda t: t > at))


def _last_until(fires: Column, at: Column) -> Column:
    return F.array_max(F.filter(fires, lambda t: t <= at))


def with_times(df: DataFrame, at: Column, expression: str, zone: str = "UTC", days: int = 366, after: str = "next", before: str = "last") -> DataFrame:
    """df with upcoming() and previous() of each row, for many rows: what depends on the day alone is made once a day."""
    rows = _with_fires(df, "_after", at, days, expression, zone, 3)
    rows = _with_fires(rows, "_before", at - F.make_dt_interval(F.lit(days)), days, expression, zone, 3, True)
    return rows.withColumns({after: _first_after(F.col("_after"), at), before: _last_until(F.col("_before"), at)}).drop("_after", "_before")


def slots(df: DataFrame, start: Column, end: Column, expression: str, zone: str = "UTC", days: int = 62, most: int = SLOTS) -> DataFrame:
    """A row for each fire in (start, end], the first `most` of a row of df; end at most `days` after start."""
    rows = _with_fires(df, "_fires", start, days, expression, zone, most // len(_minutes(fields(expression))) + 3)
    found = F.filter(F.array_sort("_fires"), lambda t: (t > start) & (t <= end))
    return rows.select(*df.columns, F.explode(F.slice(found, 1, most)).alias("slot"))


def firing(schedules: DataFrame, fires: DataFrame, now: Column, expression: str, zone: str = "UTC", grace: int = 10) -> DataFrame:
    """schedule_id and slot of schedules (lead_minutes) whose last slot before now and lead is no older than the grace and not in fires."""
    horizon = now + F.make_dt_interval(F.lit(0), F.lit(0), F.col("lead_minutes"))
    rows = schedules.withColumn("slot", previous(horizon, expression, zone, 40)).where(F.col("slot") >= horizon - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace)))
    return rows.select("schedule_id", "slot").join(fires.select("schedule_id", "slot"), ["schedule_id", "slot"], "left_anti")


def walked(expression: str, zone: str, start: datetime, end: datetime, most: int = SLOTS) -> Iterator[datetime]:
    """The fires in (start, end], the first `most`, day by day: what slots() gives, where each row has its own schedule."""
    minutes, days, months, week = (fields(expression)[i] for i in (0, 2, 3, 4))
    times, clock = _minutes(fields(expression)), ZoneInfo(zone)
    day, found = start.astimezone(clock).date() - timedelta(days=1), 0
    while found < most and day <= end.astimezone(clock).date():
        by_day, by_week = days is None or day.day in days, week is None or day.isoweekday() % 7 in week
        either = by_day or by_week if days is not None and week is not None else by_day and by_week
        if either and (months is None or day.month in months):
            made = sorted(datetime(day.year, day.month, day.day, m // 60, m % 60, tzinfo=clock).astimezone(timezone.utc) for m in times)
            for at in made:
                if start < at <= end and found < most:
                    found += 1
                    yield at
        day += timedelta(days=1)


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, pd.Timestamp(at)) for k, cron, zone, a, b in batch[["schedule_id", "cron", "zone", "first", "last"]].itertuples(index=False) for at in walked(cron, zone, datetime.fromtimestamp(a / 1e6, timezone.utc), datetime.fromtimestamp(b / 1e6, timezone.utc))]
        yield pd.DataFrame({"schedule_id": [k for k, _ in rows], "micros": [at.value // 1000 for _, at in rows]}, dtype="int64")


def content_plan(schedules: DataFrame, fires: DataFrame, drafts: DataFrame, candidates: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """schedule_id, slot, prepare_at, outcome, drafts, candidates: the slots of the last day and the next `days`.

    schedules: schedule_id, cron, zone, created_at, lead_minutes, content_kinds (array); fires:
    schedule_id, slot, outcome; drafts: draft_id, schedule_id, scheduled_for, status; candidates:
    kind and candidates (stories of that kind; those of a schedule's kinds are summed). Slots before a schedule was made
    were not missed: they are left out, but for those with a fire or a draft. drafts
    is an array of (draft_id, status) in their order, empty for none.
    """
    start = now - F.make_dt_interval(F.lit(0), F.lit(PAST))
    first = F.greatest(start, F.col("created_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(GRACE)))
    bounds = schedules.select("schedule_id", "cron", "zone", F.unix_micros(first).alias("first"), F.unix_micros(now + F.make_dt_interval(F.lit(days))).alias("last"))
    found = bounds.mapInPandas(_planned, "schedule_id long, micros long").select("schedule_id", F.timestamp_micros("micros").alias("slot"))
    made = drafts.where(F.col("scheduled_for") > start).groupBy("schedule_id", F.col("scheduled_for").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("draft_id", "status"))).alias("drafts"))
    fired = fires.where(F.col("slot") > start).groupBy("schedule_id", "slot").agg(F.max("outcome").alias("outcome"), F.lit(True).alias("fired"))
    counts = schedules.select("schedule_id", F.explode("content_kinds").alias("kind")).join(candidates, "kind").groupBy("schedule_id").agg(F.sum("candidates").alias("candidates"))
    rows = found.join(schedules, "schedule_id").join(fired, ["schedule_id", "slot"], "left").join(made, ["schedule_id", "slot"], "left").join(counts, "schedule_id", "left")
    rows = rows.where((F.col("slot") > F.col("created_at")) | F.col("fired") | F.col("drafts").isNotNull())
    lead = F.make_dt_interval(F.lit(0), F.lit(0), F.col("lead_minutes"))
    none = F.array().cast("array<struct<draft_id:bigint,status:string>>")
    return rows.select("schedule_id", "slot", (F.col("slot") - lead).alias("prepare_at"), "outcome", F.coalesce(F.col("drafts").cast("array<struct<draft_id:bigint,status:string>>"), none).alias("drafts"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))
