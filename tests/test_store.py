"""Stored mart: month partitions prune, reports from the stored mart equal the lazy ones,
materialized order facts, idempotent snapshot append, category translation."""

import datetime as dt
import os


from conftest import SF001
from salesmart.operators import reports as R
from salesmart.operators.mart import Mart, sales, translate_categories
from salesmart.operators.orders import order_facts
from salesmart.plans import store
from salesmart.plans.queries import Job
from salesmart.plans.store import load_mart, materialize, month_filter_prunes, store_mart, stored_mart
from salesmart.sinks.writers import append_snapshot


def test_stored_mart_reports(spark, tmp_out):
    j = Job(spark, SF001)
    root = os.path.join(tmp_out, "mart")
    store_mart(j.mart, root)
    m = load_mart(spark, root)
    s = sales(m, j.p.period)
    assert month_filter_prunes(s)
    o = materialize(spark, order_facts(s, j.p.thresholds), "order_facts_test")
    a = R.executive_dashboard(o).first().asDict()
    b = R.executive_dashboard(j.orders).first().asDict()
    assert a == b


def small_mart(spark, rows):
    fato = spark.createDataFrame(rows, "id_pedido long, id_produto long, data date")
    dims = [fato.select(c).distinct() for c in ("id_pedido", "id_produto", "id_produto", "data")]
    return Mart(fato, *dims)


def test_tasks_of_the_stored_mart_grow_in_number_with_its_input(spark, tmp_out, monkeypatch):
    """merged to 64 MB of compressed rows, or at a fixed number of partitions, tasks sort more than they can hold."""
    rows = [(i, i % 7, dt.date(1990 + i % 9, 1 + i % 12, 1)) for i in range(500)] + [(None, None, None)] * 3
    source = os.path.join(tmp_out, "source.parquet")
    spark.createDataFrame(rows, "a long, b long, c date").write.parquet(source)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.files.maxPartitionBytes")
    before, seen = [spark.conf.get(n) for n in names], []
    write = store.write_parquet
    monkeypatch.setattr(store, "PARTITION_BYTES", 100)
    monkeypatch.setattr(store, "write_parquet", lambda *a: (seen.append([spark.conf.get(n) for n in names]), write(*a)))
    m = stored_mart(spark, lambda: small_mart(spark, rows), [source])
    size = sum(f[1] for f in store.listed_files(spark, [source]))
    assert size > 800 and {int(s[0]) for s in seen} == {-(-size // 100)}
    assert seen[0][1] == "false" and int(seen[0][3]) > 0 and {int(s[2].rstrip("b")) for s in seen[1:]} == {100}
    assert before == [spark.conf.get(n) for n in names]
    assert sorted(map(str, m.fato.select("id_pedido", "id_produto", "data").collect())) == sorted(map(str, small_mart(spark, rows).fato.collect()))


def test_a_task_with_more_months_than_open_files(spark, tmp_out):
    rows = [(i, 1, dt.date(1950 + i % 60, 1 + i % 12, 1)) for i in range(700)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        store_mart(small_mart(spark, rows), os.path.join(tmp_out, "mart"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = load_mart(spark, os.path.join(tmp_out, "mart")).fato.select("id_pedido", "id_produto", "data", "ano_mes").collect()
    assert sorted((r[0], r[1], r[2], str(r[3])) for r in got) == [(*r, r[2].strftime("%Y-%m")) for r in rows]


def test_snapshot_append_is_idempotent(spark, tmp_out):
    path = os.path.join(tmp_out, "kpis")
    day1 = spark.createDataFrame([(dt.date(2024, 1, 1), 10.0)], "data_calculo date, receita double")
    day2 = spark.createDataFrame([(dt.date(2024, 1, 2), 11.0)], "data_calculo date, receita double")
    append_snapshot(day1, path)
    append_snapshot(day2, path)
    append_snapshot(day2, path)  # a retried run replaces its own date
    got = sorted((str(r[1]), r[0]) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", 10.0), ("2024-01-02", 11.0)]


def test_translate_categories(spark):
    dim = spark.createDataFrame([("p1", "beleza_saude"), ("p2", None), ("p3", "sem_traducao")],
                                "id_produto string, categoria_produto string")
    tr = spark.createDataFrame([("beleza_saude", "health_beauty")],
                               "product_category_name string, product_category_name_english string")
    got = {r["id_produto"]: r["categoria_produto_en"] for r in translate_categories(dim, tr).collect()}
    assert got == {"p1": "health_beauty", "p2": None, "p3": None}
