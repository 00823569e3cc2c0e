"""Calendar helpers over naive timestamps (D1-D11). All return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elapsed_micros(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def whole_days(start, end) -> Column:
    """Whole days of elapsed time, floored (noon to midnight 36 h later is 1)."""
    return F.floor(elapsed_micros(start, end) / F.lit(MICROS_PER_DAY)).cast("long")


def fractional_days(start, end) -> Column:
    """Elapsed time in days as a double."""
    return elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))


def year_week_sunday(ts) -> Column:
    """D3: ``%Y-%U`` — week 00 holds the days before the year's first Sunday."""
    d = F.to_date(_c(ts))
    week = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def year_month(ts) -> Column:
    """``yyyy-MM``."""
    return F.date_format(_c(ts), "yyyy-MM")


def minute_text(ts) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def last_month_start(anchor) -> Column:
    """First day of the month before ``anchor`` when it is the 1st, else of its month."""
    return F.trunc(F.date_sub(_c(anchor), 1), "MM")


def calendar_windows(anchor) -> dict[str, tuple[Column, Column]]:
    """Inclusive date bounds of last/previous week and month for an anchor date."""
    a = _c(anchor)
    lm = last_month_start(a)
    pm = F.add_months(lm, -1)
    return {
        "last_week": (F.date_sub(a, 6), a),
        "prev_week": (F.date_sub(a, 13), F.date_sub(a, 7)),
        "last_month": (lm, F.last_day(lm)),
        "prev_month": (pm, F.last_day(pm)),
    }


def day_index(ts, first_date, offset: int = 3) -> Column:
    """Calendar days since the first date of the data, plus ``offset``."""
    return (F.datediff(F.to_date(_c(ts)), _c(first_date)) + offset).cast("long")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a naive timestamp (comparable output)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return elapsed_micros(epoch, _c(ts))
