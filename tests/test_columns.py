"""Column functions on hand-made rows (FIXTURES §5: T1, T2, T14, T18, T23, C17)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from salesmart.functions.columns import (city_normal, critical_flag, delivered_flag, elapsed_days, late_flag,
                                         safe_double, safe_double_or_zero, safe_timestamp, share_pct)
from salesmart.functions.text import brl, days_text, int_text, number_br, pct_text
from salesmart.params import Thresholds


def test_elapsed_days_floor(spark):
    est = dt.datetime(2018, 1, 2)
    rows = [(est, dt.datetime(2018, 1, 2, 23)), (est, dt.datetime(2018, 1, 3)), (est, dt.datetime(2018, 1, 1, 12)),
            (est, None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(elapsed_days("a", "b")).collect()]
    assert got == [0, 1, -1, None]


def test_late_and_delivered_flags(spark):
    rows = [("delivered", 0), ("delivered", 1), ("delivered", -1), ("shipped", 5), ("delivered", None), (None, 3)]
    df = spark.createDataFrame(rows, "s string, d long")
    got = [(r[0], r[1]) for r in df.select(late_flag("s", "d"), delivered_flag("s")).collect()]
    assert got == [(0, 1), (1, 1), (0, 1), (None, 0), (None, 1), (None, 0)]


def test_bad_text_becomes_null(spark):
    df = spark.createDataFrame([("2018-01-02 10:00:00", "1.5"), ("xx", "abc"), (None, None)], "t string, n string")
    got = df.select(safe_timestamp("t").alias("t"), safe_double("n").alias("n"),
                    safe_double_or_zero("n").alias("z")).collect()
    assert got[0]["t"] == dt.datetime(2018, 1, 2, 10) and got[0]["n"] == 1.5
    assert got[1]["t"] is None and got[1]["n"] is None and got[1]["z"] == 0.0
    assert got[2]["z"] == 0.0


def test_critical_edges(spark):
    th = Thresholds(Decimal("100"), Decimal("0.30"))
    rows = [(Decimal("99.99"), Decimal("30.00")), (Decimal("90.00"), Decimal("27.00")),
            (Decimal("100.00"), Decimal("50.00")), (Decimal("0.00"), Decimal("0.00")), (None, None)]
    df = spark.createDataFrame(rows, "v decimal(18,4), f decimal(18,4)")
    got = [r[0] for r in df.select(critical_flag("v", "f", th)).collect()]
    assert got == [1, 0, 0, 0, 0]  # exactly 30 % is not above; total 100 is not below


def test_share_pct_guard(spark):
    df = spark.createDataFrame([(Decimal("10"), Decimal("40")), (Decimal("1"), Decimal("0"))], "f decimal(10,2), v decimal(10,2)")
    got = [r[0] for r in df.select(share_pct("f", "v")).collect()]
    assert got == [25.0, None]


def test_text_formats(spark):
    df = spark.createDataFrame([(15786203.57, 0.125, 99092, 12.5)], "m double, p double, n long, d double")
    r = df.select(brl("m"), pct_text("p"), int_text("n"), number_br("m"), days_text("d")).first()
    assert r[0] == "R$ 15.786.203,57"
    assert r[1] == "0,13%"
    assert r[2] == "99.092"
    assert r[3] == "15.786.203,57"
    assert r[4] == "13 dias"


def test_city_normal(spark):
    df = spark.createDataFrame([(" SAO PAULO ",), ("osasco",), ("OSASCO",), ("brasilia",), (None,)], "c string")
    got = [r[0] for r in df.select(city_normal("c")).collect()]
    assert got == ["São Paulo", "osasco", "osasco", "Brasília", None]


def test_ansi_stays_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("1",)], "x string")
    assert df.select(F.col("x").try_cast("int")).first()[0] == 1


def test_day_counts_ignore_session_zone(spark):
    # 2000-10-08 starts daylight saving in São Paulo: 12:00 -> 12:00 next day is 23 real hours,
    # but one wall-clock day, as in the reference's naive timestamps
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        rows = [(dt.datetime(2000, 10, 7, 12), dt.datetime(2000, 10, 8, 12)),
                (dt.datetime(2000, 10, 8, 0), dt.datetime(2000, 10, 9, 0))]
        df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
        assert [r[0] for r in df.select(elapsed_days("a", "b")).collect()] == [1, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
