"""Schema gate, CSV quarantine, rates with a literal table, stored mart with pruned months, catalog load."""

import datetime as dt
import json
import os
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from salesmart.plans import storage
from salesmart.plans.store import months_by_calendar
from salesmart.sinks import catalog as K
from salesmart.sinks.writers import list_tables
from salesmart.sources import gate as G
from salesmart.sources import rates as X
from salesmart.sources.files import fallback_rates
from salesmart.sources.quarantine import read_csv_split


def test_gate_finds_each_kind(spark, tmp_out):
    a = os.path.join(tmp_out, "a")
    spark.createDataFrame([(1, "x"), (None, "y")], "id long, t string").write.parquet(a)
    spark.createDataFrame([(3, 1.5)], "id long, late double").write.mode("append").parquet(a)  # another file, another column
    clash = os.path.join(tmp_out, "clash")
    spark.createDataFrame([(1,)], "id long").write.parquet(clash)
    spark.createDataFrame([("1",)], "id string").write.mode("append").parquet(clash)
    broken = os.path.join(tmp_out, "broken")
    os.makedirs(broken)
    open(os.path.join(broken, "x.parquet"), "w").write("no parquet")
    text = os.path.join(tmp_out, "t.csv")
    open(text, "w").write("﻿id,nome\n1,a\n")
    report = G.input_report(spark, {
        "a": G.Input(a, "ID bigint, t int, gone string", ("id",)), "clash": G.Input(clash, "id bigint"), "broken": G.Input(broken, "id bigint"),
        "none": G.Input(os.path.join(tmp_out, "nope"), "id bigint", ("id",)), "csv": G.Input(text, "id int, idade int", ("id",), "csv"),
    })
    got = {(r.tabela, r.coluna): (r.situacao, r.linhas, r.nulos) for r in report.collect()}
    assert got == {
        ("a", "ID"): (G.OK, 3, 1), ("a", "t"): (G.RETYPED, None, None), ("a", "gone"): (G.MISSING, None, None), ("a", "late"): (G.EXTRA, None, None),
        ("clash", None): (G.UNREADABLE, None, None), ("broken", None): (G.UNREADABLE, None, None), ("none", None): (G.ABSENT, None, None),
        ("csv", "id"): (G.OK, 1, 0), ("csv", "idade"): (G.MISSING, None, None), ("csv", "nome"): (G.EXTRA, None, None),
    }
    with pytest.raises(ValueError, match="a.ID: ok, 1 nulls"):
        G.require(report)
    G.require(G.input_report(spark, {"a": G.Input(a, "id bigint, t string")}))
    assert G.input_report(spark, {"none": G.Input("/nope", "id bigint")}).first().linhas is None


CSV = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("valor", T.DecimalType(8, 2)), T.StructField("dia", T.TimestampType()), T.StructField("nome", T.StringType())])


def test_csv_split_loses_no_line(spark, tmp_out):
    p = os.path.join(tmp_out, "x.csv")
    lines = ["﻿id,valor,dia,nome", "1,2.50,2018-01-02 03:04:05,ana", "x,2,2018-01-02 00:00:00,b", "3,um,ontem,c", "4,,,", '5,1,,"a, ""b"""', "6,1", "7,1,,d,mais"]
    open(p, "w").write("\n".join(lines) + "\n")
    rows, rejects = read_csv_split(spark, p, CSV)
    assert rows.dtypes == [("id", "int"), ("valor", "decimal(8,2)"), ("dia", "timestamp"), ("nome", "string")]
    got = {r.id: (r.valor, r.dia, r.nome) for r in rows.collect()}
    assert got == {1: (Decimal("2.50"), dt.datetime(2018, 1, 2, 3, 4, 5), "ana"), 4: (None, None, None), 5: (Decimal("1.00"), None, 'a, "b"')}
    bad = sorted((tuple(r.motivos), tuple(sorted(r.textos.items())), r.registro) for r in rejects.collect())
    assert bad == [
        (("id",), (("id", "x"),), None), (("registro",), (), "6,1"), (("registro",), (), "7,1,,d,mais"),
        (("valor", "dia"), (("dia", "ontem"), ("valor", "um")), None),
    ]
    assert rows.count() + rejects.count() == len(lines) - 1 and all(r.arquivo.endswith("x.csv") for r in rejects.collect())
    # a narrow selection changes nothing of what is rejected
    assert rows.select("id").count() == 3
    other, none = read_csv_split(spark, p, T._parse_datatype_string("id string, valor string, dia date, nome string"), patterns={"dia": "yyyy-MM-dd HH:mm:ss"})
    assert {r.dia for r in other.collect()} == {dt.date(2018, 1, 2), None} and none.count() == 3


def body(*quotes):
    return json.dumps({"value": [{"cotacaoCompra": 1.0, "cotacaoVenda": v, "dataHoraCotacao": d} for d, v in quotes]}, indent=1)


def test_rates_fall_back_by_year(spark, tmp_out):
    texts = {2016: body(("2016-12-01 10:00", 3.0), ("2016-12-02 10:00", 4.0)), 2017: body(("2017-01-02 10:00", 9.9))[:-20], 2018: body(("2018-02-01 10:00", 5.0), ("bad", 7.0))}
    for year, text in texts.items():
        os.makedirs(os.path.join(tmp_out, "r", f"ano={year}"))
        open(os.path.join(tmp_out, "r", f"ano={year}", "b.json"), "w").write(text)
    months = spark.createDataFrame([("2016-12",), ("2017-01",), ("2018-01",), ("2018-02",), ("2019-01",)], "ano_mes string")
    got = {r.ano_mes: (r.taxa, r.origem) for r in X.rates_or_table(spark, os.path.join(tmp_out, "r"), months, fallback_rates(spark)).collect()}
    assert got == {"2016-12": (3.5, "json"), "2017-01": (3.15, "tabela"), "2018-01": (None, None), "2018-02": (5.0, "json"), "2019-01": (None, None)}
    assert {r.falhou for r in X.read_bodies(spark, os.path.join(tmp_out, "r")).where("ano = 2017").collect()} == {True}
    none = X.rates_or_table(spark, os.path.join(tmp_out, "nope"), months, fallback_rates(spark)).collect()
    assert {r.ano_mes: r.origem for r in none} == {"2016-12": None, "2017-01": "tabela", "2018-01": "tabela", "2018-02": "tabela", "2019-01": None}


def scans(df):
    """Metrics of the file scans of an executed plan."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            m = leaf.metrics()
            out.append({k: m.apply(k).value() for k in ("numFiles", "numPartitions") if m.contains(k)})
    return out


def test_calendar_prunes_months_at_run_time(spark):
    m = storage.mart_of(spark, SF001)
    again = storage.mart_of(spark, SF001)
    assert m.fato.inputFiles() and sorted(m.fato.inputFiles()) == sorted(again.fato.inputFiles())  # stored once
    months = m.fato.select("ano_mes").distinct().count()
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        part = months_by_calendar(m, F.col("trimestre") == 4).groupBy("ano_mes").count()
        fact = [s for s in scans(part) if "numPartitions" in s]
        whole = [s for s in scans(m.fato.groupBy("ano_mes").count()) if "numPartitions" in s]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    wanted = part.count()
    assert whole[0]["numPartitions"] == months and fact[0]["numPartitions"] == wanted < months / 3
    assert fact[0]["numFiles"] < whole[0]["numFiles"] / 3


def test_database_load_is_all_or_nothing(spark):
    db = f"salesmart_load_{uuid.uuid4().hex[:8]}"
    dim, fact = spark.range(5).withColumnRenamed("id", "k"), spark.range(20).selectExpr("id % 5 AS k", "cast(id % 2 AS string) AS ano_mes")
    got = K.load_database(spark, db, {"dim_x": dim, "fato": fact}, {"fato": ["ano_mes"]}).orderBy("ordem").collect()
    assert [tuple(r) for r in got] == [(1, "dim_x", 5, 5, True), (2, "fato", 20, 20, True)]
    assert spark.table(f"{db}.fato").columns == ["k", "ano_mes"]
    K.load_database(spark, db, {"dim_x": dim.limit(2), "fato": fact.limit(7)})
    assert (spark.table(f"{db}.dim_x").count(), spark.table(f"{db}.fato").count()) == (2, 7)
    # the second table fails while it is written: neither is changed, no staged table stays
    with pytest.raises(Exception):
        K.load_database(spark, db, {"dim_x": dim, "fato": fact.select(F.raise_error(F.lit("stop")).alias("k"))})
    assert (spark.table(f"{db}.dim_x").count(), spark.table(f"{db}.fato").count()) == (2, 7)
    names = [r.table_name for r in list_tables(spark, db).collect()]
    assert [n for n in names if "__" not in n] == ["dim_x", "fato"] and len(names) == 4
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_names_turn_back_if_one_cannot_be_set(spark, monkeypatch):
    db = f"salesmart_swap_{uuid.uuid4().hex[:8]}"
    K.load_database(spark, db, {"a": spark.range(1), "b": spark.range(2)})
    spark.range(9).write.saveAsTable(f"{db}.a__other")  # of the second table there is none
    with pytest.raises(Exception):
        K._swap(spark, db, ["a", "b"], "other")
    assert (spark.table(f"{db}.a").count(), spark.table(f"{db}.b").count()) == (1, 2)
    # a table that is not whole is found before any name turns
    monkeypatch.setattr(K, "write_table", lambda df, name, by: df.where("id < 3").write.saveAsTable(name))
    with pytest.raises(RuntimeError, match="a: 3 of"):
        K.load_database(spark, db, {"a": spark.range(0, 8, 1, 1), "b": spark.range(2)})
    assert spark.table(f"{db}.a").count() == 1
    spark.sql(f"DROP DATABASE {db} CASCADE")


@pytest.mark.parametrize("key", sorted(storage.registry()))
def test_stored_keys_have_a_twin_and_run(spark, key):
    assert key in storage.oracle()
    assert storage.registry()[key](spark, SF001).count() > 0
