"""Dates, times and schedules as column functions.  All instants are naive UTC."""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

_DAY = 86_400_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _utc(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def parse_iso_utc(c: str | Column) -> Column:
    """ISO date or date-time; an offset is applied and dropped; anything else is NULL."""
    c = _col(c)
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    parsed = F.when(zoned, _utc(c.try_cast("timestamp"))).otherwise(c.try_cast("timestamp_ntz"))
    return F.when(shaped, parsed)


# RFC zone names and their offsets (fixed values)
_MAIL_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800",
    "PDT": "-0700",
}


def parse_rfc2822(c: str | Column) -> Column:
    """Mail ``Date`` header to naive UTC; NULL where it cannot be read."""
    v = F.regexp_replace(_col(c), r"\s*\([^)]*\)\s*$", "")
    v = F.trim(F.regexp_replace(F.regexp_replace(v, r"^\s*[A-Za-z]{3},?\s+", ""), r"\s+", " "))
    for name, offset in _MAIL_ZONES.items():
        v = F.regexp_replace(v, f" {name}$", f" {offset}")
    v = F.regexp_replace(v, r" -0000$", " +0000")
    v = F.regexp_replace(v, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})( |$)", "$1:00$2")
    zoned = _utc(F.try_to_timestamp(v, F.lit("d MMM yyyy HH:mm:ss Z")))
    naive = F.try_to_timestamp(v, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(v.rlike(r"[+-]\d{4}$"), zoned).otherwise(naive)


def parse_internal_date(c: str | Column) -> Column:
    """``01-Jan-2024 10:00:00 +0200`` to naive UTC."""
    return _utc(F.try_to_timestamp(F.trim(_col(c)), F.lit("d-MMM-yyyy HH:mm:ss Z")))


@cache
def _zone_names() -> tuple[str, ...]:
    skip = {"localtime", "Factory", "posixrules"}
    return tuple(sorted(z for z in zoneinfo.available_timezones() if z not in skip))


def ics_start(value: str | Column, params: str | Column, local_zone: str) -> Column:
    """Start of a calendar event in the local zone, as naive time.

    All-day dates are midnight, ``Z`` and TZID times are moved to the local zone, floating
    times are kept, and an unknown zone counts as the local one.
    """
    value, params = _col(value), F.coalesce(_col(params), F.lit(""))
    zones = _zone_names()
    local = F.lit(local_zone if local_zone in zones else "UTC")
    def naive(text: Column, pattern: str) -> Column:
        return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")

    day = naive(F.substring(value, 1, 8), "yyyyMMdd")
    at = naive(F.rtrim(value, F.lit("Z")), "yyyyMMdd'T'HHmmss")
    tzid = F.regexp_extract(params, "TZID=([^;:]+)", 1)
    source = F.when(tzid.isin(*zones), tzid).otherwise(local)
    all_day = F.contains(params, F.lit("VALUE=DATE")) | (F.length(value) == 8)
    return (
        F.when(all_day, day)
        .when(value.endswith("Z"), F.convert_timezone(F.lit("UTC"), local, at))
        .when(tzid != "", F.convert_timezone(source, local, at))
        .otherwise(at)
    )


def month_start(c: str | Column) -> Column:
    return F.date_trunc("month", _col(c)).cast("timestamp_ntz")


def next_month(c: str | Column) -> Column:
    return (month_start(c) + F.expr("INTERVAL '1' MONTH")).cast("timestamp_ntz")


def previous_month(c: str | Column) -> Column:
    return (month_start(c) - F.expr("INTERVAL '1' MONTH")).cast("timestamp_ntz")


def period_of(c: str | Column) -> Column:
    """``yyyy-MM`` of a timestamp or date."""
    return F.substring(_col(c).cast("string"), 1, 7)


def day_of(c: str | Column) -> Column:
    return F.substring(_col(c).cast("string"), 1, 10)


def prior_period(period: str | Column) -> Column:
    first = F.concat(_col(period), F.lit("-01")).cast("date")
    return F.substring(F.add_months(first, -1).cast("string"), 1, 7)


def valid_period(c: str | Column) -> Column:
    """First seven characters of a text date that starts with year and month, else ''."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.rlike(r"^\d{4}-\d{2}"), F.substring(c, 1, 7)).otherwise(F.lit(""))


def extract_date(c: str | Column) -> Column:
    """First ISO date, else first "Month d, yyyy", as ISO text; '' if neither is a real date."""
    c = _col(c)
    iso = F.regexp_extract(c, fixed.ISO_DATE_PATTERN, 1).try_cast("date")
    named = F.regexp_extract(c, fixed.MONTH_DATE_PATTERN, 1)
    short = F.regexp_replace(
        F.initcap(named), r"^([A-Za-z]{3})[A-Za-z]*\s+(\d{1,2}),\s+(\d{4})$", "$1 $2, $3"
    )
    spelled = F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("MMM d, yyyy")).cast("date")
    return F.coalesce(iso.cast("string"), spelled.cast("string"), F.lit(""))


def extract_times(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(fixed.TIME_PATTERN), 1)


def local_datetime(date: str | Column, time: str | Column) -> Column:
    """ISO date and "h[:mm] AM" to ISO local time; '' where the time is impossible."""
    date, time = _col(date), _col(time)
    shape = r"^(1[0-2]|0?[1-9])(?::([0-5]?\d))? (AM|PM)$"
    clean = F.trim(F.regexp_replace(F.upper(time), r"\s+", " "))
    hour = F.regexp_extract(clean, shape, 1).try_cast("int") % 12
    minute = F.coalesce(F.regexp_extract(clean, shape, 2).try_cast("int"), F.lit(0))
    hour = hour + F.when(clean.endswith("PM"), 12).otherwise(0)
    text = F.concat(
        date, F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
        F.lpad(minute.cast("string"), 2, "0"), F.lit(":00"),
    )
    return F.when((date != "") & clean.rlike(shape), text).otherwise(F.lit(""))


def zone_abbreviations(c: str | Column) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(fixed.ZONE_PATTERN), 1)
    return F.array_distinct(F.transform(found, F.upper))


def zone_abbreviation(c: str | Column) -> Column:
    """The only zone named in the text, else ''."""
    found = zone_abbreviations(c)
    return F.when(F.size(found) == 1, F.get(found, 0)).otherwise(F.lit(""))


def to_utc(local: str | Column, zone: str | Column) -> Column:
    """Local ISO text and zone abbreviation to naive UTC; an unknown zone gives NULL."""
    offsets = F.create_map(*[F.lit(v) for kv in fixed.ZONE_HOURS.items() for v in kv])
    hours = F.try_element_at(offsets, _col(zone))
    at = F.nullif(_col(local), F.lit("")).cast("timestamp_ntz")
    return (at - F.make_dt_interval(F.lit(0), hours)).cast("timestamp_ntz")


def _iso(ts: Column) -> Column:
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))


def with_schedule(df: DataFrame, text: str | Column, out: str = "schedule") -> DataFrame:
    """Adds struct(local_start, local_end, zone, start_utc, end_utc, ambiguity).

    Built in steps so that each pattern runs once per row.
    """
    staged = df.withColumns({
        "_date": extract_date(text), "_times": extract_times(text),
        "_zones": zone_abbreviations(text),
        "_minutes": F.regexp_extract(_col(text), fixed.DURATION_PATTERN, 1).try_cast("int"),
    })
    staged = staged.withColumns({
        "_zone": F.when(F.size("_zones") == 1, F.get("_zones", F.lit(0))).otherwise(F.lit("")),
        "_ls": local_datetime("_date", F.coalesce(F.get("_times", F.lit(0)), F.lit(""))),
        "_le": local_datetime("_date", F.coalesce(F.get("_times", F.lit(1)), F.lit(""))),
    })
    staged = staged.withColumns({"_s": to_utc("_ls", "_zone"), "_e": to_utc("_le", "_zone")})
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("_minutes"))
    extend = F.col("_s").isNotNull() & F.col("_e").isNull() & F.col("_minutes").isNotNull()
    local = F.nullif(F.col("_ls"), F.lit("")).cast("timestamp_ntz")
    reasons = F.array(
        F.when(
            (F.col("_date") != "") & (F.size("_times") > 0) & (F.col("_ls") == ""),
            F.lit(fixed.AMBIGUITY_UNPARSED),
        ),
        F.when((F.col("_ls") != "") & (F.col("_zone") == ""), F.lit(fixed.AMBIGUITY_NO_ZONE)),
        F.when(F.size("_zones") > 1, F.lit(fixed.AMBIGUITY_ZONES)),
    )
    schedule = F.struct(
        F.col("_ls").alias("local_start"),
        F.when(extend, _iso((local + minutes).cast("timestamp_ntz")))
        .otherwise(F.col("_le")).alias("local_end"),
        F.col("_zone").alias("zone"),
        F.col("_s").alias("start_utc"),
        F.when(extend, (F.col("_s") + minutes).cast("timestamp_ntz"))
        .otherwise(F.col("_e")).alias("end_utc"),
        F.filter(reasons, lambda r: r.isNotNull()).alias("ambiguity"),
    )
    return staged.withColumn(out, schedule).drop(
        "_date", "_times", "_zones", "_minutes", "_zone", "_ls", "_le", "_s", "_e"
    )


def elapsed_days(a: str | Column, b: str | Column) -> Column:
    """Whole days between two instants: floored first, sign dropped after."""
    micros = F.timestamp_diff("MICROSECOND", _col(b), _col(a))
    return F.abs(((micros - F.pmod(micros, F.lit(_DAY))) / F.lit(_DAY)).cast("bigint"))


def serial_date(c: str | Column) -> Column:
    """Spreadsheet serial day (counted from 1899-12-30) to a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(_col(c)).cast("int"))


def month_spine(spark, first: Column | str, last: Column | str) -> DataFrame:
    """One row ``period`` per month of a closed range of dates (bounded by the range)."""
    return spark.range(1).select(
        F.explode(
            F.sequence(
                F.trunc(_col(first).cast("date"), "month"),
                F.trunc(_col(last).cast("date"), "month"),
                F.expr("INTERVAL '1' MONTH"),
            )
        ).alias("month")
    ).select(F.substring(F.col("month").cast("string"), 1, 7).alias("period"))
