"""Column expressions for cleaning and derived measures (all JVM-side).

Each function returns a ``Column`` so it composes inside ``select`` /
``withColumn`` and stays in whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesmart.params import Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_timestamp(c, fmt: str | None = None) -> Column:
    """Text to timestamp; unparseable text becomes NULL."""
    c = _c(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def safe_double(c) -> Column:
    """Text to number, bad values NULL."""
    return _c(c).try_cast("double")


def safe_double_or_zero(c) -> Column:
    """Text to number, bad or missing values 0."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0))


def elapsed_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored.

    12 hours early is -1; "late" needs a full day. ``timestampdiff(DAY)``
    truncates toward zero and ``datediff`` counts midnights, so neither fits
    alone: floor(end - start) is the midnights crossed, minus one when the
    end's time of day is before the start's. Everything is wall-clock
    arithmetic on timestamps without time zone, so the session time zone
    (and a daylight-saving switch inside the span) cannot move the result.
    """
    a, b = _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz")
    tod_a = a - F.to_date(a).cast("timestamp_ntz")
    tod_b = b - F.to_date(b).cast("timestamp_ntz")
    return (F.datediff(F.to_date(b), F.to_date(a)) - F.when(tod_b < tod_a, 1).otherwise(0)).cast("bigint")


def late_flag(status, delay_days, delivered_status: str = "delivered") -> Column:
    """1 late, 0 on time, NULL when not delivered or the delay is unknown."""
    status, delay_days = _c(status), _c(delay_days)
    return (F.when(~status.eqNullSafe(F.lit(delivered_status)) | delay_days.isNull(), F.lit(None))
            .otherwise((delay_days > 0).cast("int"))
            .cast("int"))


def delivered_flag(status, delivered_status: str = "delivered") -> Column:
    """1 when the status is the delivered one, else 0; never NULL."""
    return _c(status).eqNullSafe(F.lit(delivered_status)).cast("int")


def item_total(price, freight) -> Column:
    """Product value plus freight, NULL if either is NULL."""
    return _c(price) + _c(freight)


def year_month(ts) -> Column:
    """Zero-padded ``yyyy-MM`` key; sorts by time as text.

    Formatted from the date, so a timestamp without time zone never passes
    through the session zone.
    """
    return F.date_format(F.to_date(_c(ts)), "yyyy-MM")


def month_name(d) -> Column:
    """Full English month name (C11); ``monthname`` gives the short form."""
    return F.date_format(_c(d), "MMMM")


def share_pct(part, whole) -> Column:
    """``part / whole * 100`` as double, NULL unless ``whole > 0``."""
    part, whole = _c(part), _c(whole)
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0))


def critical_flag(value, freight, th: Thresholds) -> Column:
    """1 when ``0 < value < max_value`` and ``freight > share * value``.

    Compared in decimals as ``freight > share * value`` (not ``freight/value >
    share``) so boundary orders do not move with division scale.
    """
    value, freight = _c(value), _c(freight)
    share = F.lit(Decimal(th.freight_share))
    return (F.when((value > 0) & (value < F.lit(Decimal(th.max_value))) & (freight > share * value), 1)
            .otherwise(0).cast("int"))


# The city spellings the reference corrects after trim + lower
# (all other cities keep their trimmed lower-case form).
CITY_FIXES = {
    "sao paulo": "São Paulo",
    "rio de janeiro": "Rio de Janeiro",
    "belo horizonte": "Belo Horizonte",
    "brasilia": "Brasília",
    "curitiba": "Curitiba",
    "campinas": "Campinas",
    "porto alegre": "Porto Alegre",
    "salvador": "Salvador",
    "guarulhos": "Guarulhos",
    "sao bernardo do campo": "São Bernardo do Campo",
}


def city_normal(c, fixes: dict[str, str] | None = None) -> Column:
    """trim + lower, then the fixed spellings; unknown cities unchanged (C17)."""
    fixes = CITY_FIXES if fixes is None else fixes
    key = F.lower(F.trim(_c(c)))
    lookup = F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, key), key)
