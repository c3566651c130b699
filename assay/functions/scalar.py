"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, NULL where the bottom is 0."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def days_between(start: Column, end: Column) -> Column:
    """Whole microseconds between two moments, as fractional days."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(DAY_MICROS))


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a zoneless moment, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, moment)


def days_later(moment: Column, days: int) -> Column:
    return moment + F.make_dt_interval(F.lit(days))


def logit(p: Column) -> Column:
    """Log-odds, with p kept 1e-6 away from 0 and 1."""
    kept = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(kept / (F.lit(1.0) - kept))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))



def provenance_of(scan_config: Column) -> Column:
    """feed, or customer for everything else, NULL included."""
    return F.when(scan_config == "feed", F.lit("feed")).otherwise(F.lit("customer"))


def scan_action(actions: Column) -> Column:
    """The scan flag of a JSON action map: its own key, else the default key, else true."""
    own = F.get_json_object(actions, "$.scan")
    default = F.get_json_object(actions, "$._default")
    return F.coalesce(own, default, F.lit("true")).cast("boolean")


def safe_long(text: Column) -> Column:
    """A bigint, or 0 where the text is not one."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def year_of(moment: Column) -> Column:
    return F.year(moment).cast("int")
