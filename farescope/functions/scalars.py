"""Column expressions shared by all operators. No UDFs: all run in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farescope.schemas import MONEY

NUMERIC_TEXT = r"^[0-9]+(\.[0-9]+)?$"
HOUR_TOLERANCE = 0.01
# The largest gap that counts as exact where a bound must be included.
EXACT_GAP = HOUR_TOLERANCE - 1e-10

GOOD, BAD, NEUTRAL = "favourable", "unfavourable", "neutral"


def clean_text(c: Column) -> Column:
    """Trimmed text; blank and the literal ``None`` become NULL."""
    t = F.trim(c)
    return F.when((t != "") & (t != "None"), t)


def parse(c: Column, type_name: str) -> Column:
    """Parse text to ``type_name``; anything unparsable becomes NULL."""
    t = clean_text(c)
    if type_name == "string":
        return c
    if type_name == "date":
        return parse_date(t)
    if type_name == "int":
        # '191.0' is how a nullable integer column is written by a pandas job.
        return F.coalesce(
            t.try_cast("int"),
            F.when(t.rlike(r"^-?[0-9]+\.0+$"), t.try_cast("decimal(18,2)").try_cast("int")),
        )
    v = t.try_cast(type_name)
    if type_name == "double":
        return F.when(~F.isnan(v), v)
    return v


def parse_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10).try_cast("date"))


def parse_stamp(c: Column) -> Column:
    """``DD-MM-YYYY HH:MM:SS`` text to a zone-free timestamp, so that it sorts by time."""
    iso = F.regexp_replace(F.trim(c), r"^(\d{2})-(\d{2})-(\d{4}) ", "$3-$2-$1 ")
    return F.when(F.trim(c).rlike(r"^\d{2}-\d{2}-\d{4} "), iso.try_cast("timestamp_ntz"))


# A feed file is `<anything>YYYY-MM-DD_HH-MM.csv`, or a directory of that name.
FILE_STAMP = r"(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})\.csv(?:/[^/]*)?$"


def file_snapshot_date(path: Column) -> Column:
    return F.regexp_extract(path, FILE_STAMP, 1).try_cast("date")


def file_snapshot_time(path: Column) -> Column:
    h, m = F.regexp_extract(path, FILE_STAMP, 2), F.regexp_extract(path, FILE_STAMP, 3)
    return F.when(h != "", F.concat(h, F.lit(":"), m, F.lit(":00")))


def file_snapshot_ts(path: Column) -> Column:
    day = F.regexp_extract(path, FILE_STAMP, 1)
    text = F.concat(day, F.lit(" "), file_snapshot_time(path))
    return text.try_cast("timestamp_ntz")


def week_start(d: Column) -> Column:
    """The Sunday on or before ``d``."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def blank_as_zero(c: Column, type_name: str = MONEY) -> Column:
    return F.coalesce(parse(c, type_name), F.lit(0).cast(type_name))


def blank_else(c: Column, other: Column) -> Column:
    """``c`` unless it is NULL or empty text."""
    return F.when(c.isNotNull() & (c != ""), c).otherwise(other)


def delta(actual: Column, model: Column) -> Column:
    """Actual minus model; 0 when either is missing."""
    return F.coalesce(actual - model, F.lit(0))


def delta_percent(actual: Column, model: Column) -> Column:
    """Delta as a percentage of the model; 0 when undefined."""
    return _percent(actual - model, model)


def delta_percent_of_actual(actual: Column, model: Column) -> Column:
    """Model minus actual as a percentage of the actual; 0 when undefined."""
    return F.when(
        (model != 0) & (actual != 0), _percent(model - actual, actual)
    ).otherwise(F.lit(0.0))


def _percent(part: Column, whole: Column) -> Column:
    whole = whole.cast("double")
    return F.coalesce(
        F.when(whole != 0, part.cast("double") / whole * 100), F.lit(0.0)
    )


def status(actual: Column, model: Column) -> Column:
    """A model above the actual is good for the business, below it is bad."""
    return (
        F.when(model > actual, GOOD).when(model < actual, BAD).otherwise(NEUTRAL)
    )


def is_numeric_text(c: Column) -> Column:
    return c.rlike(NUMERIC_TEXT)


def demand_value(c: Column) -> Column:
    """The numeric reading of a demand index, NULL for a grade such as ``M/L``."""
    return F.when(is_numeric_text(c), c.try_cast("double"))


def demand_grade(c: Column) -> Column:
    """The grade reading of a demand index, NULL for a number."""
    return F.when(~is_numeric_text(c), c)


def near_hour(hours: Column, wanted: float) -> Column:
    """``|hours - wanted| < 0.01`` written as a range, which parquet can prune on."""
    return (hours > F.lit(wanted - HOUR_TOLERANCE)) & (hours < F.lit(wanted + HOUR_TOLERANCE))


def near_hour_text(hours: Column, wanted: float | str) -> Column:
    """Tolerance match for numeric text, plain equality for anything else."""
    text = str(wanted)
    try:
        number = float(wanted)
    except (TypeError, ValueError):
        return hours == F.lit(text)
    return F.when(
        is_numeric_text(hours),
        F.abs(hours.try_cast("double") - F.lit(number)) < HOUR_TOLERANCE,
    ).otherwise(hours == F.lit(text))


def hour_label(hours: Column) -> Column:
    """Hours as text, whole numbers without a decimal part."""
    return F.when(
        hours == F.floor(hours), hours.cast("bigint").cast("string")
    ).otherwise(hours.cast("string"))


def departure_ts(day: Column, time_text: Column) -> Column:
    text = F.concat(day.cast("string"), F.lit(" "), time_text)
    return text.try_cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours; whole seconds, sign kept."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(3600.0)


def is_past(date_text: Column, as_of: Column) -> Column:
    """True when the date lies before ``as_of``; invalid or missing dates are not past."""
    return F.coalesce(parse_date(date_text) < as_of, F.lit(False))


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First day of the month and of the next one (half-open)."""
    first = F.trunc(day, "month")
    return first, F.add_months(first, 1)


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")
