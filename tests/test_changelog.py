"""Snapshot diff, log view, retention and change application."""

import datetime as dt
import json

from salesmart.operators.changelog import apply_changes, change_log, change_log_view, retain


def test_snapshot_diff_and_apply(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "id string, cidade string, n int")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y2", 2), ("d", "w", 4)], "id string, cidade string, n int")
    at = dt.datetime(2024, 5, 1, 12, 0)
    log = change_log(old, new, "id", "dim_clientes", at)
    ops = {r["chave"]: r for r in log.collect()}
    assert {k: r["operacao"] for k, r in ops.items()} == {"b": "UPDATE", "c": "DELETE", "d": "INSERT"}
    assert json.loads(ops["b"]["dados_anteriores"]) == {"id": "b", "cidade": "y", "n": 2}
    assert json.loads(ops["b"]["dados_novos"]) == {"id": "b", "cidade": "y2", "n": 2}
    assert ops["d"]["dados_anteriores"] is None and ops["c"]["dados_novos"] is None
    applied = sorted(tuple(r) for r in apply_changes(old, log, "id").collect())
    assert applied == sorted(tuple(r) for r in new.collect())
    view = change_log_view(log, width=10).collect()
    assert all(len(r["resumo"]) <= 10 for r in view)


def test_null_safe_compare(spark):
    old = spark.createDataFrame([("a", None)], "id string, v string")
    new = spark.createDataFrame([("a", None)], "id string, v string")
    assert change_log(old, new, "id", "t", dt.datetime(2024, 1, 1)).count() == 0


def test_retention_boundary(spark):
    run = dt.date(2024, 5, 1)
    rows = [("k90", dt.datetime(2024, 2, 1)), ("k91", dt.datetime(2024, 1, 31)), ("k0", dt.datetime(2024, 4, 30))]
    log = spark.createDataFrame(rows, "chave string, data_consulta timestamp_ntz")
    kept = {r[0] for r in retain(log, run, 90).collect()}
    assert kept == {"k90", "k0"}  # exactly 90 days old stays; 91 goes
