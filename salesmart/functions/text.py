"""Report-edge text formats, Brazilian style.

Values are rounded half-up as decimals first, then printed, so 0.125 prints
``0,13`` regardless of its binary double form (T14). Always two decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's report texts -- money prefix, day-count suffix,
# and the yes / no words of the critical-order verdict.
CURRENCY_PREFIX = "R$ "
DAYS_SUFFIX = " dias"
YES, NO = "Sim", "Não"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dec2(c) -> Column:
    return F.round(_c(c).cast("decimal(38,10)"), 2)


def number_br(c, decimals: int = 2) -> Column:
    """``1234567.891`` -> ``1.234.567,89``."""
    rounded = F.round(_c(c).cast("decimal(38,10)"), decimals)
    return F.translate(F.format_number(rounded, decimals), ",.", ".,")


def brl(c) -> Column:
    """Money text ``R$ 1.234,56``."""
    return F.concat(F.lit(CURRENCY_PREFIX), number_br(c, 2))


def pct_text(c) -> Column:
    """Percent text with decimal comma, no grouping: ``17,28%`` (X2); NULL stays NULL (``format_string`` prints it)."""
    d = _dec2(c).cast("double")
    return F.when(d.isNotNull(), F.concat(F.regexp_replace(F.format_string("%.2f", d), r"\.", ","), F.lit("%")))


def int_text(c) -> Column:
    """Integer text with dot groups: ``99.092``."""
    return F.translate(F.format_number(_c(c).cast("bigint"), 0), ",", ".")


def days_text(c) -> Column:
    """Rounded day count with suffix: ``12 dias``."""
    return F.concat(F.round(_c(c).cast("decimal(38,10)"), 0).cast("bigint").cast("string"), F.lit(DAYS_SUFFIX))


def millions(c) -> Column:
    """Display scaling."""
    return _c(c).cast("double") / F.lit(1_000_000.0)
