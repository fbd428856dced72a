"""Month and quarter labels as text, and the ratios built on them."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(ts: Column) -> Column:
    """202505 for May 2025: a cheap grouping key; labels are made from it after grouping."""
    return F.year(ts) * 100 + F.month(ts)


def month_label(number: Column) -> Column:
    """202505 -> '2025-05'."""
    digits = number.cast("string")
    return F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2))


def quarter_of_month(month: Column) -> Column:
    """'2025-05' -> '2025-Q2'."""
    number = F.floor((F.substring(month, 6, 2).cast("int") + 2) / 3).cast("string")
    return F.concat(F.substring(month, 1, 4), F.lit("-Q"), number)


def months_of_quarter(quarter: str) -> list[str]:
    """'2025-Q2' -> ['2025-04', '2025-05', '2025-06']."""
    year, number = quarter.split("-Q")
    first = 3 * int(number) - 2
    return [f"{year}-{m:02d}" for m in range(first, first + 3)]


def in_months(ts: Column, months: list[str]) -> Column:
    """Rows of the given months, as ranges on the raw timestamp so that the scan can prune."""
    spans: list[list[dt.datetime]] = []
    for month in sorted(set(months)):
        start = dt.datetime.strptime(month, "%Y-%m")
        end = (start + dt.timedelta(days=32)).replace(day=1)
        if spans and spans[-1][1] == start:
            spans[-1][1] = end
        else:
            spans.append([start, end])

    def at(moment: dt.datetime) -> Column:
        return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")

    return functools.reduce(operator.or_, [(ts >= at(a)) & (ts < at(b)) for a, b in spans])


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Rounded quotient; NULL on a zero denominator."""
    return F.round(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), digits)
