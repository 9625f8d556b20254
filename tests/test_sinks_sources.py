"""Sources and sinks: CSV with schema and BOM, Brazilian CSV round trip, JSON rates,
Parquet table, snapshot append, keyed refresh, JDBC on in-memory Derby, catalog listing."""

import datetime as dt
import glob
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.sinks import writers as W
from salesmart.sources import files as S


def _text(folder):
    return "".join(open(f).read() for f in sorted(glob.glob(os.path.join(folder, "part-*.csv"))))


def test_csv_with_bom_and_schema(spark, tmp_out):
    p = os.path.join(tmp_out, "cat.csv")
    with open(p, "wb") as fh:
        fh.write("﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n".encode())
    df = S.read_csv(spark, p, S.CATEGORY_TRANSLATION)
    assert df.columns == ["product_category_name", "product_category_name_english"]
    assert df.first()[0] == "beleza_saude"


def test_brazilian_csv_round_trip(spark, tmp_out):
    df = spark.createDataFrame([("2017-01", Decimal("137188.49"), None)], "ano_mes string, receita decimal(12,2), x decimal(12,2)")
    out = os.path.join(tmp_out, "br")
    W.write_csv_br(df, out)
    text = _text(out)
    assert "ano_mes;receita;x" in text and "2017-01;137188,49;" in text
    back = S.read_csv_br(spark, out, df.schema)
    assert back.first()["receita"] == Decimal("137188.49")


def test_csv_export_nulls_empty(spark, tmp_out):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    out = os.path.join(tmp_out, "csv")
    W.write_csv(df, out)
    assert "a," in _text(out)


def test_rates_json_and_fallback(spark, tmp_out):
    body = {"value": [{"cotacaoCompra": 3.1, "cotacaoVenda": 3.2, "dataHoraCotacao": "2017-01-02 13:11:00.000"},
                      {"cotacaoCompra": 3.0, "cotacaoVenda": 3.0, "dataHoraCotacao": "2017-01-20 13:11:00.000"}]}
    p = os.path.join(tmp_out, "rates.json")
    json.dump(body, open(p, "w"))
    r = S.read_rates_json(spark, p)
    assert [tuple(x) for x in r.orderBy("data").collect()][0] == (dt.date(2017, 1, 2), 3.1, 3.2, "2017-01")
    assert S.fallback_rates(spark).count() == 20


def test_inputs_checks(tmp_out):
    with pytest.raises(FileNotFoundError):
        S.require_inputs({"orders": os.path.join(tmp_out, "nope.csv")})
    p = os.path.join(tmp_out, "b.csv")
    open(p, "w").write("x\n")
    assert S.first_existing([os.path.join(tmp_out, "a.csv"), p]) == p


def test_parquet_append_refresh(spark, tmp_out):
    df = spark.createDataFrame([("2017-01", 1.0), ("2017-02", 2.0)], "ano_mes string, v double")
    W.write_parquet(df, os.path.join(tmp_out, "fact"), ["ano_mes"])
    back = spark.read.parquet(os.path.join(tmp_out, "fact")).where(F.col("ano_mes") == "2017-02")
    assert back.count() == 1
    snap = os.path.join(tmp_out, "kpis")
    W.append_snapshot(df.where("ano_mes = '2017-01'"), snap, run_col="ano_mes")
    W.append_snapshot(df.where("ano_mes = '2017-01'"), snap, run_col="ano_mes")  # same run again: no duplicate
    W.append_snapshot(df.where("ano_mes = '2017-02'"), snap, run_col="ano_mes")
    assert spark.read.parquet(snap).count() == 2
    W.refresh(df, os.path.join(tmp_out, "monthly"), ["ano_mes"])
    with pytest.raises(ValueError):
        W.refresh(df.unionByName(df), os.path.join(tmp_out, "monthly2"), ["ano_mes"])


def test_catalog_tables(spark):
    W.create_database(spark, "salesmart_test")
    df = spark.createDataFrame([(1,)], "a int")
    W.write_table(df, "salesmart_test.t_b")
    W.write_table(df, "salesmart_test.t_a")
    names = [r[1] for r in W.list_tables(spark, "salesmart_test").collect()]
    assert names == ["t_a", "t_b"]
    spark.sql("DROP DATABASE salesmart_test CASCADE")


def test_jdbc_derby_load(spark):
    jars = glob.glob(os.path.join(os.path.dirname(__import__("pyspark").__file__), "jars", "derby-*.jar"))
    if not jars:
        pytest.skip("no Derby jar")
    url = "jdbc:derby:memory:salesmart;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    dim = spark.createDataFrame([("u1", "SP")], "id_cliente string, estado_cliente string")
    fact = spark.createDataFrame([("o1", "u1", 10.0)], "id_pedido string, id_cliente string, valor double")
    W.load_jdbc({"DIM_CLIENTES": dim, "FATO_VENDAS": fact}, url, props)
    W.load_jdbc({"DIM_CLIENTES": dim, "FATO_VENDAS": fact}, url, props)  # reload empties, no duplicates
    assert spark.read.jdbc(url, "FATO_VENDAS", properties=props).count() == 1
