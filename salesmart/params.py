"""Report parameters: period, thresholds, group minimums.

The reference hard-codes one period and fixed thresholds in every query; here
they are arguments so the same jobs run on any data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class Period:
    """Inclusive date range; month keys are derived from it."""

    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start: str, end: str) -> "Period":
        return cls(dt.date.fromisoformat(start), dt.date.fromisoformat(end))

    @property
    def first_month(self) -> str:
        return self.start.strftime("%Y-%m")

    @property
    def last_month(self) -> str:
        return self.end.strftime("%Y-%m")

    @property
    def n_months(self) -> int:
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1


@dataclass(frozen=True)
class Thresholds:
    """Critical order: total below ``max_value`` and freight above ``freight_share`` of it."""

    max_value: Decimal = Decimal("100")
    freight_share: Decimal = Decimal("0.30")


@dataclass(frozen=True)
class Params:
    period: Period
    thresholds: Thresholds = field(default_factory=Thresholds)
    min_orders: int = 100  # HAVING minimum of the late-rate ranking
    delivered_status: str = "delivered"
    top_k: int = 10
    focus_state: str = "SP"
    hot_rows: int = 5_000_000  # rows of one key above which a join key is salted
    # the two windows of activity that the change log compares
    log_old: Period = Period(dt.date(2017, 1, 1), dt.date(2017, 12, 31))
    log_new: Period = Period(dt.date(2018, 1, 1), dt.date(2018, 8, 31))


# Fixed values of the reference's own study: period Jan 2017 - Aug 2018,
# critical order total < R$100 with freight > 30 %, late ranking needs >= 100 orders.
STUDY = Params(period=Period.of("2017-01-01", "2018-08-31"))


def driver_params() -> Params:
    """Parameters for the driver's TPC-H-shaped tables.

    Status 'F' plays "delivered"; money is in the thousands, so the critical
    threshold is 100000 with a 5 % freight share; the HAVING minimum is one
    constant, whatever the data's size or folder.
    """
    return Params(
        period=Period.of("1996-01-01", "2000-12-31"),
        thresholds=Thresholds(Decimal("100000"), Decimal("0.05")),
        min_orders=450,
        delivered_status="F",
        top_k=10,
        focus_state="NATION_7",
        log_old=Period.of("1997-01-01", "1998-12-31"),
        log_new=Period.of("1999-01-01", "2000-12-31"),
    )
