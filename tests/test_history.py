"""Partitioned tables: refresh of what changed, retention by day, snapshots; Brazilian numbers to the last bit; item reports from one scan."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from salesmart.sinks import history as H
from salesmart.sinks.writers import append_snapshot, write_csv_br
from salesmart.sources.files import read_csv_br_exact


def files(path):
    return {f for f in glob.glob(os.path.join(path, "*", "*.parquet"))}


def summary(rows):
    return rows.groupBy("m").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def test_refresh_builds_changed_months_only(spark, tmp_out):
    path = os.path.join(tmp_out, "t")
    first = [("01", 1, 5), ("01", 2, 6), ("02", 3, 1), ("02", 3, 1), ("03", 4, None), (None, 5, 2), ("05", 6, 1)]
    schema = "m string, id int, v int"

    def refresh(rows):
        df = spark.createDataFrame(rows, schema).repartition(3)
        got = {r.m: r.situacao for r in H.refresh_changed(df, path, "m", summary).collect()}
        table = sorted((str(r.m), r.total, r.n) for r in spark.read.schema("total long, n long, m string").parquet(path).collect())
        assert table == sorted((str(r.m), r.total, r.n) for r in summary(df).collect())  # as a full refresh has it
        return got

    assert set(refresh(first).values()) == {H.NEW}
    before = files(path)
    assert set(refresh(first[::-1]).values()) == {H.SAME} and files(path) == before
    # a repeated row more, a month gone, one new, a null that got a value
    second = [("01", 2, 6), ("01", 1, 5), *[("02", 3, 1)] * 3, ("03", 4, 9), (None, 5, 2), ("06", 7, 7)]
    assert refresh(second) == {"01": H.SAME, "02": H.REBUILT, "03": H.REBUILT, None: H.SAME, "05": H.GONE, "06": H.NEW}
    kept = {f for f in before if "m=01" in f or "m=__HIVE" in f}
    assert kept and kept <= files(path)
    assert refresh(first)["05"] == H.NEW and set(refresh(first).values()) == {H.SAME}


def test_refresh_that_broke_off_is_done_again(spark, tmp_out):
    path = os.path.join(tmp_out, "t")
    rows = spark.createDataFrame([("01", 1, 5), ("02", 2, 6)], "m string, id int, v int")
    with pytest.raises(Exception):
        H.refresh_changed(rows, path, "m", lambda r: summary(r).withColumn("n", F.raise_error(F.lit("stop")).cast("long")))
    assert {r.situacao for r in H.refresh_changed(rows, path, "m", summary).collect()} == {H.NEW}
    assert spark.read.parquet(path).count() == 2


def test_retention_rewrites_the_border_day_only(spark, tmp_out):
    path = os.path.join(tmp_out, "log")
    stamps = ["2018-01-01 00:00:00", "2018-01-01 23:59:59", "2018-01-02 11:59:59", "2018-01-02 12:00:00", "2018-01-03 00:00:00", "2018-01-04 10:00:00"]
    log = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "id int, s string")
    log = log.select("id", F.col("s").cast("timestamp_ntz").alias("em")).withColumn("dia", F.to_date("em"))
    log.repartition(1).write.partitionBy("dia").parquet(path)
    later = {f for f in files(path) if "01-03" in f or "01-04" in f}
    cutoff = dt.datetime(2018, 1, 2, 12)
    assert H.retain_days(spark, path, cutoff, "dia", "em") == {"2018-01-01": H.GONE, "2018-01-02": H.REBUILT}
    assert {r.id for r in spark.read.parquet(path).collect()} == {3, 4, 5} and later < files(path)
    assert H.retain_days(spark, path, cutoff, "dia", "em") == {"2018-01-02": H.REBUILT}  # again: the same rows
    assert {r.id for r in spark.read.parquet(path).collect()} == {3, 4, 5}
    # nothing of the border day stays; a cutoff at midnight has no border day
    assert H.retain_days(spark, path, dt.datetime(2018, 1, 2, 13), "dia", "em") == {"2018-01-02": H.GONE}
    assert H.retain_days(spark, path, dt.datetime(2018, 1, 4), "dia", "em") == {"2018-01-03": H.GONE}
    assert {r.id for r in spark.read.parquet(path).collect()} == {5}


def test_run_changes(spark, tmp_out):
    path = os.path.join(tmp_out, "k")
    for day, v in ((3, 7.5), (1, 2.0), (3, 9.0)):
        append_snapshot(spark.createDataFrame([(dt.date(2018, 1, day), v)], "data_calculo date, v double"), path)
    got = [tuple(r) for r in H.run_changes(spark.read.parquet(path), "data_calculo", ["v"]).orderBy("data_calculo").collect()]
    assert got == [(dt.date(2018, 1, 1), 2.0, None), (dt.date(2018, 1, 3), 9.0, 7.0)]


def test_brazilian_doubles_come_back_exact(spark, tmp_out):
    values = [0.1, -2.675, 1 / 3, 1e-9, 123456789.123456789, 15786203.57, -0.0, 5.0, 1e22, 1.7976931348623157e308, 5e-324, None]
    df = spark.createDataFrame([(i, v, f'a;"{i}"') for i, v in enumerate(values)], "id int, v double, t string").withColumn("d", F.col("id").cast("decimal(10,3)"))
    out = os.path.join(tmp_out, "br")
    write_csv_br(df, out)
    back = read_csv_br_exact(spark, out, df.schema)
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    p = os.path.join(tmp_out, "x.csv")
    open(p, "w").write("v;n\n1.234.567,89;7\nx;8\n")
    assert [tuple(r) for r in read_csv_br_exact(spark, p, spark.createDataFrame([], "v double, n int").schema).collect()] == [(1234567.89, 7), (None, 8)]


@pytest.mark.parametrize("key", ["revenue_by_category", "items_by_category", "revenue_by_seller", "item_value", "item_freight_pct"])
def test_item_reports_read_the_items_once(spark, key):
    from salesmart.plans.queries import registry

    df = registry()[key](spark, SF01)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1


def test_change_log_between_other_windows(spark):
    from salesmart.params import Period, driver_params
    from salesmart.plans.queries import Job

    p = driver_params()
    same = Job(spark, SF001).change_log.count()
    other = Job(spark, SF001, p.__class__(**{**p.__dict__, "log_old": Period.of("1996-01-01", "1996-12-31"), "log_new": Period.of("1996-01-01", "1996-12-31")}))
    assert same > 0 and other.change_log.count() == 0
    old = Job(spark, SF001, p.__class__(**{**p.__dict__, "log_old": Period.of("1990-01-01", "1990-12-31")}))
    assert {r.operacao for r in old.change_log.select("operacao").distinct().collect()} == {"INSERT"}
