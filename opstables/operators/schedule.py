"""Cron schedules (F9, G8, T9 as a batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.functions import scalars
from opstables.operators.ranks import if_small
from opstables.sources.scratch import stored

#: Names of months and days in cron fields.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def field_values(text: Column, low: int, high: int, names: tuple[str, ...] = (), first: int = 0) -> Column:
    """The integers that a cron field (stars, lists, ranges, steps, names) stands for, as an array."""
    text = F.lower(text)
    for i, name in enumerate(names):
        text = F.replace(text, F.lit(name), F.lit(str(i + first)))

    def part(p: Column) -> Column:
        span, step = F.substring_index(p, "/", 1), F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", -1).cast("int")).otherwise(1)
        lo = F.when(span == "*", low).otherwise(F.substring_index(span, "-", 1).cast("int"))
        single = ~F.contains(span, F.lit("-")) & ~F.contains(p, F.lit("/"))
        hi = F.when(span == "*", high).when(F.contains(span, F.lit("-")), F.substring_index(span, "-", -1).cast("int")).when(single, lo).otherwise(high)
        return F.sequence(lo, hi, step)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), part))))


def cron_fields(df: DataFrame, cron: str) -> DataFrame:
    """The five fields as arrays; Sunday is 0 or 7; day of month and day of week hold either, if both are restricted."""
    f = F.split(F.trim(F.col(cron)), r"\s+")
    dow = F.array_distinct(F.transform(field_values(f[4], 0, 7, DAYS), lambda d: d % 7))
    return df.withColumns(
        {"_min": field_values(f[0], 0, 59), "_hour": field_values(f[1], 0, 23), "_dom": field_values(f[2], 1, 31), "_mon": field_values(f[3], 1, 12, MONTHS, 1), "_dow": dow, "_any_dom": f[2].startswith("*"), "_any_dow": f[4].startswith("*")}
    )


def fires(schedules: DataFrame, cron: str, start: str, end: str) -> DataFrame:
    """All fires from start up to end (excluded), as timestamps `fire_at`: first the days that match, then their hours and minutes."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("_day")
    rows = cron_fields(schedules, cron).select("*", days)
    dom, dow = F.array_contains("_dom", F.dayofmonth("_day")), F.array_contains("_dow", F.dayofweek("_day") - 1)
    day_ok = F.when(F.col("_any_dom") | F.col("_any_dow"), dom & dow).otherwise(dom | dow)
    hours = rows.where(F.array_contains("_mon", F.month("_day")) & day_ok).withColumn("_h", F.explode("_hour")).withColumn("_m", F.explode("_min"))
    at = F.timestamp_seconds(F.unix_seconds(F.col("_day").cast("timestamp")) + F.col("_h") * 3600 + F.col("_m") * 60)
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return hours.withColumn("fire_at", at).where((F.col("fire_at") >= low) & (F.col("fire_at") < high)).select(*schedules.columns, "fire_at")


#: Days after which every pattern that fires at all has fired: 29 February can be eight years away.
HORIZON_DAYS = 2922


def next_fire(schedules: DataFrame, cron: str, after: str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """the first fire after a moment, within the horizon (null if none): days first, then the first minute of the first day that has one left.

    Days beyond the first year are looked at only for the patterns that have no day in it.  A pattern is worked out once, however many schedules have it.
    """
    low = F.lit(after).cast("timestamp")
    spark = schedules.sparkSession
    patterns = schedules.select(F.col(cron).alias("_cron")).where("_cron IS NOT NULL").distinct()
    rows = cron_fields(patterns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_cron"), "_cron")

    def day(i: Column) -> Column:
        return F.date_add(F.to_date(low), i)

    def ok(i: Column) -> Column:
        dom, dow = F.array_contains(F.col("_dom"), F.dayofmonth(day(i))), F.array_contains(F.col("_dow"), F.dayofweek(day(i)) - 1)
        return F.array_contains(F.col("_mon"), F.month(day(i))) & F.when(F.col("_any_dom") | F.col("_any_dow"), dom & dow).otherwise(dom | dow)

    def first_day(low: int, high: int) -> Column:
        return F.get(F.filter(F.sequence(F.lit(low), F.lit(high)), ok), 0) if low <= high else F.lit(None).cast("int")

    minutes = F.array_sort(F.flatten(F.transform("_hour", lambda h: F.transform(F.col("_min"), lambda m: h * 60 + m))))
    now = F.hour(low) * 60 + F.minute(low)
    rows = rows.withColumns({"_later": F.coalesce(first_day(1, min(366, horizon_days)), first_day(367, horizon_days)), "_minutes": minutes})
    left_today = F.get(F.filter(F.col("_minutes"), lambda m: m > now), 0)
    today = ok(F.lit(0)) & left_today.isNotNull()
    offset = F.when(today, F.lit(0)).otherwise(F.col("_later"))
    minute = F.when(today, left_today).otherwise(F.get("_minutes", 0))
    at = F.timestamp_seconds(F.unix_seconds(F.date_add(F.to_date(low), offset).cast("timestamp")) + minute * 60)
    found = stored(rows.select("_cron", at.alias("next_fire_at")), "patterns")
    return schedules.join(if_small(found), F.col(cron) == F.col("_cron"), "left").select(*(schedules[c] for c in schedules.columns), found["next_fire_at"])


def due_schedules(schedules: DataFrame, as_of: str) -> DataFrame:
    """Enabled ones whose next fire has come; null and malformed times are passed over."""
    at = F.try_to_timestamp("next_fire_at")
    return schedules.where(F.col("enabled") & at.isNotNull() & (at <= F.lit(as_of).cast("timestamp")))


def fire(due: DataFrame, as_of: str) -> DataFrame:
    """The task that a due schedule gives: its idempotency key and id."""
    key = scalars.cron_key(F.col("schedule_id"), F.lit(as_of))
    return due.select("schedule_id", "tenant_id", key.alias("idempotency_key"), scalars.cron_task_id(key).alias("task_id"))
