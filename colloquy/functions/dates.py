"""Date phrases, absolute dates and ages, always relative to an explicit ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from colloquy.packs import ZH, DuePhrase, RulePack


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_time(as_of) -> Column:
    """A Column for a timestamp literal written as text, or the Column itself."""
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of.cast("timestamp_ntz")


def _plus_days(ts: Column, date: Column) -> Column:
    """The given date with the clock time of ``ts``."""
    days = F.datediff(date, F.to_date(ts))
    return ts + F.make_dt_interval(days)


def parse_task_phrase(col, as_of, phrases: Sequence[DuePhrase] = ZH.due_phrases) -> Column:
    """Task flavour: keeps the clock time of ``as_of`` except for month ends; null when unknown."""
    text, now = F.btrim(_col(col)), as_time(as_of)
    today = F.to_date(now)
    out = F.lit(None).cast("timestamp_ntz")
    for p in reversed(phrases):
        if p.rule == "weekday":
            value = _plus_days(now, F.next_day(today, p.weekday))
        elif p.rule == "weekday_after":
            value = _plus_days(now, F.date_add(F.next_day(today, p.weekday), 7))
        elif p.rule == "month_end":
            value = F.last_day(today).cast("timestamp_ntz")
        else:
            raise ValueError(f"unknown due rule {p.rule}")
        out = F.when(text == p.phrase, value).otherwise(out)
    return out


# Fixed values of the entity date phrases: weekday digits and quarter starts.
_WEEKDAYS = (("一", 0), ("二", 1), ("三", 2), ("四", 3), ("五", 4), ("六", 5), ("日", 6), ("天", 6))
_QUARTERS = (("1", 1), ("一", 1), ("2", 4), ("二", 4), ("3", 7), ("三", 7), ("4", 10), ("四", 10))


def parse_entity_phrase(col, as_of) -> Column:
    """Entity flavour: midnight values; unknown phrases give null."""
    text = _col(col)
    today = F.to_date(as_time(as_of))
    dow = F.weekday(today)
    next_week = F.lit(None).cast("date")
    # the first weekday digit of the phrase decides
    digit = F.regexp_extract(text, "[一二三四五六日天]", 0)
    for ch, target in _WEEKDAYS:
        ahead = (7 - dow + target) % 7
        ahead = F.when(ahead == 0, 7).otherwise(ahead)
        next_week = F.when(digit == ch, F.date_add(today, ahead.cast("int"))).otherwise(next_week)
    quarter = F.lit(None).cast("date")
    for key, month in reversed(_QUARTERS):
        start = F.make_date(F.year(today), F.lit(month), F.lit(1))
        start = F.when(start < today, F.add_months(start, 12)).otherwise(start)
        quarter = F.when(text.contains(key), start).otherwise(quarter)
    friday = F.next_day(today, "FRI")
    out = (
        F.when(text.rlike("本周五|这周五"), friday)
        .when(text.contains("下周一"), F.date_add(today, (7 - dow).cast("int")))
        .when(text.contains("下周"), next_week)
        .when(text.contains("下个月"), F.date_add(F.last_day(today), 1))
        .when(text.rlike("月底|月末"), F.last_day(today))
        .when(text.rlike("Q|季度"), quarter)
        .when(text.contains("今天"), today)
        .when(text.contains("明天"), F.date_add(today, 1))
        .when(text.contains("昨天"), F.date_sub(today, 1))
    )
    return out.cast("timestamp_ntz")


def parse_absolute(col, as_of) -> Column:
    """Year-month-day and month-day dates; impossible dates give null."""
    text = _col(col)

    def build(pattern: str, year: Column | None) -> Column:
        g = 0 if year is not None else 1
        y = year if year is not None else F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        m = F.nullif(F.regexp_extract(text, pattern, g + 1), F.lit(""))
        d = F.nullif(F.regexp_extract(text, pattern, g + 2), F.lit(""))
        iso = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
        return F.try_to_date(iso, "yyyy-MM-dd")

    this_year = F.year(as_time(as_of)).cast("string")
    return F.coalesce(
        build("([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", None),
        build("([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", None),
        build("([0-9]{1,2})月([0-9]{1,2})日", this_year),
    ).cast("timestamp_ntz")


def date_type(col) -> Column:
    t = _col(col)
    return (
        F.when(t.rlike("年|-"), F.lit("date"))
        .when(t.rlike("今天|明天|昨天|本周|下周|下个月|月底|月末"), F.lit("relative"))
        .when(t.rlike("^Q|季度"), F.lit("quarter"))
        .otherwise(F.lit("relative"))
    )


def entity_confidence(text, kind) -> Column:
    text, kind = _col(text), _col(kind)
    tenths = (
        F.lit(7)
        + F.when(F.length(text) >= 2, 1).otherwise(0)
        + F.when(kind == "date", 2).when(kind == "relative", -1).otherwise(0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), tenths / 10))


def days_between(later, earlier) -> Column:
    """Exact days (double) between two timestamps, not calendar days."""
    def micros(c) -> Column:
        return F.unix_micros(_col(c).cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(86400000000.0)


# Fixed value: the shape of an ISO time; day, hour, minute, second, fraction, zone.
_ISO = r"(?s)^(\d{4}-\d\d-\d\d)(?:.(\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?(Z|[+-]\d\d(?::?\d\d)?)?)?$"


def iso_time(col) -> Column:
    """The UTC time of an ISO text: a day, or a day and a clock time down to fractions of any length (cut at
    microseconds), with ``Z`` or an offset below 24 hours, or neither; null for any other text."""
    text = _col(col)
    part = lambda i: F.regexp_extract(text, _ISO, i)
    two = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("00"))
    local = F.concat(part(1), F.lit(" "), F.concat_ws(":", two(2), two(3), two(4)), F.lit("."), F.rpad(F.substring(part(5), 1, 6), 6, "0"))
    zone = F.regexp_replace(part(6), "[^0-9]", "")
    hours, minutes = (F.coalesce(F.substring(zone, k, 2).try_cast("int"), F.lit(0)) for k in (1, 3))
    east = F.when(F.startswith(part(6), F.lit("-")), -1).otherwise(1) * (hours * 60 + minutes)
    fits = text.rlike(_ISO) & (hours < 24) & (minutes < 60)
    return F.when(fits, local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=east))


def days_until(col, as_of) -> Column:
    return F.floor(days_between(col, as_time(as_of))).cast("bigint")


# The age units, largest first, and the word for "now".
_AGES = ((31536000, " 年前"), (2592000, " 月前"), (86400, " 天前"), (3600, " 小时前"), (60, " 分钟前"))
_NOW = "刚刚"


def time_ago(col, as_of) -> Column:
    secs = F.floor(days_between(as_time(as_of), col) * 86400).cast("bigint")
    out = F.lit(_NOW)
    for size, unit in reversed(_AGES):
        out = F.when(secs > size, F.concat(F.floor(secs / size).cast("string"), F.lit(unit))).otherwise(out)
    return F.when(_col(col).isNull(), F.lit("")).otherwise(out)
