"""Calendar functions on TIMESTAMP_NTZ, independent of the session time zone.

Two meanings of a pickup time exist: training data holds New York wall-clock times without a zone
(read the fields directly), serving requests hold instants (convert to New York first). Instants are
normalised to a UTC wall clock of type TIMESTAMP_NTZ, then converted with ``convert_timezone`` and
explicit zone names, so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

# The market's zone and its rush-hour windows, [start, end) in local hours.
NEW_YORK_TIMEZONE = "America/New_York"
UTC = "UTC"
RUSH_HOUR_WINDOWS = ((7, 10), (16, 19))
WEEKEND_FIRST_WEEKDAY = 5  # Monday = 0, so Saturday = 5 and Sunday = 6

_EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


# A date, a time and a zone offset at the end (Z, +hh, +hhmm or +hh:mm); a bare date has none.
OFFSET_PATTERN = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)\s*$"


def has_offset(text: Column) -> Column:
    return text.rlike(OFFSET_PATTERN)


def instant_of(text: Column) -> Column:
    """The instant of a date and time with an offset; anything else, or an impossible date, is null."""
    seconds = F.regexp_replace(F.upper(F.trim(text)), r"([T ][0-9]{2}:[0-9]{2})(\s*(Z|[+-][0-9:]+))$", "$1:00$2")
    colon = F.regexp_replace(seconds, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(has_offset(text), F.regexp_replace(colon, r"([+-][0-9]{2})$", "$1:00").try_cast("timestamp"))


def utc_wall_clock(column: Column, data_type: DataType) -> Column:
    """An instant (TIMESTAMP) or a UTC wall clock (TIMESTAMP_NTZ) as a UTC TIMESTAMP_NTZ."""
    if isinstance(data_type, TimestampNTZType):
        return column
    if isinstance(data_type, TimestampType):
        # Microseconds since the epoch are zone-free; adding them to the NTZ epoch is exact.
        return F.timestamp_add("MICROSECOND", F.unix_micros(column), F.expr(_EPOCH_NTZ))
    raise TypeError(f"expected TIMESTAMP or TIMESTAMP_NTZ, got {data_type.simpleString()}")


def utc_instant(utc_ntz: Column) -> Column:
    """A UTC wall clock (TIMESTAMP_NTZ) as an instant (TIMESTAMP), independent of the session zone.

    Event-time operators (watermarks, windows) need instants.
    """
    return F.make_timestamp_ltz(F.year(utc_ntz), F.month(utc_ntz), F.dayofmonth(utc_ntz), F.hour(utc_ntz),
                                F.minute(utc_ntz), F.date_part(F.lit("SECOND"), utc_ntz), F.lit(UTC))


def to_new_york(utc_ntz: Column) -> Column:
    """UTC wall clock -> New York wall clock (both TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit(UTC), F.lit(NEW_YORK_TIMEZONE), utc_ntz)


def hour_of(ts: Column) -> Column:
    """F3."""
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(ts)


def month_of(ts: Column) -> Column:
    """F5."""
    return F.month(ts)


def weekend_flag(weekday: Column) -> Column:
    """F6."""
    return (weekday >= F.lit(WEEKEND_FIRST_WEEKDAY)).cast("int")


def rush_hour_flag(hour: Column) -> Column:
    """local hour within one of the half-open rush windows."""
    condition = F.lit(False)
    for start, end in RUSH_HOUR_WINDOWS:
        condition = condition | ((hour >= F.lit(start)) & (hour < F.lit(end)))
    return condition.cast("int")


def calendar_fields(wall_clock: Column) -> dict[str, Column]:
    """The five time features of one wall clock, keyed by feature name."""
    hour = hour_of(wall_clock)
    weekday = weekday_of(wall_clock)
    return {
        "pickup_hour": hour,
        "pickup_day_of_week": weekday,
        "pickup_month": month_of(wall_clock),
        "is_weekend": weekend_flag(weekday),
        "is_rush_hour": rush_hour_flag(hour),
    }


# ----------------------------------------------------------------------------- SQL-text forms
# The same functions as SQL text over a column or expression: one call to the JVM per feature
# when a plan is built, instead of one per operator.

def utc_wall_clock_sql(column: str, data_type: DataType) -> str:
    """SQL text of :func:`utc_wall_clock` for the column named ``column``."""
    if isinstance(data_type, TimestampNTZType):
        return f"`{column}`"
    if isinstance(data_type, TimestampType):
        return f"timestampadd(MICROSECOND, unix_micros(`{column}`), {_EPOCH_NTZ})"
    raise TypeError(f"expected TIMESTAMP or TIMESTAMP_NTZ, got {data_type.simpleString()}")


def to_new_york_sql(utc_ntz: str) -> str:
    return f"convert_timezone('{UTC}', '{NEW_YORK_TIMEZONE}', {utc_ntz})"


def calendar_fields_sql(wall_clock: str) -> dict[str, Column]:
    """:func:`calendar_fields` from SQL text of a wall clock."""
    hour, weekday = f"hour({wall_clock})", f"weekday({wall_clock})"
    rush = " OR ".join(f"({hour} >= {start} AND {hour} < {end})" for start, end in RUSH_HOUR_WINDOWS)
    return {
        "pickup_hour": F.expr(hour),
        "pickup_day_of_week": F.expr(weekday),
        "pickup_month": F.expr(f"month({wall_clock})"),
        "is_weekend": F.expr(f"CAST({weekday} >= {WEEKEND_FIRST_WEEKDAY} AS INT)"),
        "is_rush_hour": F.expr(f"CAST({rush} AS INT)"),
    }
