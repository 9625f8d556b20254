"""Query keys of sources and sinks: files written and read back, the stored mart, the catalog.

Unlike the keys of ``plans.queries`` these write before they return: what they report on is the table or
file that lies there. All inputs come from the driver tables; every key has a DuckDB twin over the same tables.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.operators import reports as R
from salesmart.operators import series as S
from salesmart.operators.mart import Mart
from salesmart.params import driver_params
from salesmart.plans.oracle import PREFIX
from salesmart.plans.queries import Job, finish
from salesmart.plans.store import TABLES, materialize, months_by_calendar, stored_mart
from salesmart.plans.views import register_views, state_report_sql
from salesmart.session import shared_path
from salesmart.sinks.catalog import load_database
from salesmart.sinks.history import refresh_changed, retain_days, run_changes
from salesmart.sinks.writers import append_snapshot, write_csv_br
from salesmart.sources.files import FALLBACK_RATES, read_csv_br_exact
from salesmart.sources.gate import Input, input_report
from salesmart.sources.quarantine import read_csv_split
from salesmart.sources.rates import rates_or_table
from salesmart.sources.tpch import SCHEMAS, table

DATABASE = "salesmart_carga"


def _new(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def mart_of(spark: SparkSession, sf_dir: str) -> Mart:
    names = ("orders", "lineitem", "customer", "part", "supplier", "nation")
    return stored_mart(spark, lambda: Job(spark, sf_dir).mart, [os.path.join(sf_dir, f"{n}.parquet") for n in names])


#: Declared inputs that differ from the files, so that each finding has a case: a column that is not there, one that is
#: not declared, another type, a table without a file.
DECLARED = SCHEMAS | {
    "part": SCHEMAS["part"] + ", p_container string",
    "events": "event_id bigint, ts timestamp, user_id int, event_type string, value double",
    "refunds": "r_orderkey bigint",
}


def declared_fields(name: str) -> list[tuple[str, str]]:
    """(column, type) of a declared input; its types hold no commas."""
    return [tuple(f.split(" ", 1)) for f in DECLARED[name].split(", ")]


def required(name: str) -> tuple[str, ...]:
    return tuple(c for c, _ in declared_fields(name) if c.endswith(("key", "_id")))


def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared and found column of the inputs, and the nulls of the required ones."""
    return input_report(spark, {name: Input(os.path.join(sf_dir, f"{name}.parquet"), ddl, required(name)) for name, ddl in DECLARED.items()})


CSV_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(12,2), o_orderdate date, o_orderpriority string"


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders exported as CSV lines, some cut short, some with a price or a date that is none; rows and value
    that arrive, and the rejects by reason."""
    o = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    no_price = ((status == "F") & (priority == "5")) | ((status == "P") & (priority == "1"))
    no_date = ((status == "O") & (priority == "2")) | ((status == "P") & (priority == "1"))
    price = F.when(no_price, F.lit("n/d")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    date = F.when(no_date, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    start = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    rest = [F.coalesce(c, F.lit("")) for c in (price, date, F.col("o_orderpriority"))]
    cut = F.coalesce((status == "P") & (priority == "4"), F.lit(False))
    path = _new(spark, "orders-csv")
    o.select(F.when(cut, F.concat_ws(",", *start)).otherwise(F.concat_ws(",", *start, *rest)).alias("value")).write.text(path)
    rows, rejects = read_csv_split(spark, path, T._parse_datatype_string(CSV_ORDERS), header=False, patterns={"o_orderdate": "dd/MM/yyyy"})
    good = rows.agg(F.count("*").alias("linhas"), F.sum("o_totalprice").alias("valor"), F.min("o_orderdate").alias("primeira_data"))
    bad = rejects.groupBy(F.concat_ws(",", "motivos").alias("motivo")).agg(F.count("*").alias("linhas"))
    return good.select(F.lit("aceita").alias("situacao"), F.lit("").alias("motivo"), "linhas", "valor", "primeira_data").unionByName(
        bad.select(F.lit("rejeitada").alias("situacao"), "motivo", "linhas", F.lit(None).cast("decimal(22,2)").alias("valor"), F.lit(None).cast("date").alias("primeira_data")))


#: The literal rates, moved to years of the driver tables.
MOVED = [(f"{int(m[:4]) - 19}{m[4:]}", rate) for m, rate in FALLBACK_RATES]


def rates_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean quantities as nested JSON bodies by year; that of 1998 is broken, 1999 has none."""
    job = Job(spark, sf_dir)
    per = job.p.period
    day = F.to_date("l_shipdate")
    daily = table(spark, sf_dir, "lineitem").where(day.between(F.lit(per.start), F.lit(per.end))).groupBy(day.alias("d")).agg(F.avg("l_quantity").alias("q"))
    quote = F.struct(F.col("q").alias("cotacaoCompra"), F.col("q").alias("cotacaoVenda"), F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 13:00:00.000")).alias("dataHoraCotacao"))
    # 366 quotes a year at most
    body = F.to_json(F.struct(F.collect_list(quote).alias("value")))
    years = daily.groupBy(F.year("d").alias("ano")).agg(body.alias("value")).where("ano <> 1999")
    years = years.withColumn("value", F.when(F.col("ano") == 1998, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")))
    path = _new(spark, "rates-json")
    years.write.partitionBy("ano").text(path)
    got = rates_or_table(spark, path, S.month_spine(spark, per), spark.createDataFrame(MOVED, "ano_mes string, dolar_venda double"))
    return got.select("ano_mes", F.round("taxa", 6).alias("taxa"), "origem")


def stored_last_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last quarters of all years from the stored fact; only their months are read."""
    rows = months_by_calendar(mart_of(spark, sf_dir), F.col("trimestre") == 4)
    per_order = rows.groupBy("ano", "id_pedido").agg(F.sum("valor_total_item").alias("receita"), F.count("id_item_pedido").alias("itens"))
    return per_order.groupBy("ano").agg(F.sum("receita").alias("receita_total"), F.count("*").alias("total_pedidos"), F.sum("itens").alias("total_itens"))


def stored_categories_of_december(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by category in the Decembers, from the stored tables; the dimension joins on aggregated rows."""
    m = mart_of(spark, sf_dir)
    rows = months_by_calendar(m, F.col("nome_mes") == "December").where(F.col("id_produto").isNotNull())
    per_product = rows.groupBy("id_produto").agg(F.sum("valor_total_item").alias("receita"), F.count("*").alias("itens"))
    by = per_product.join(m.dim_produtos.select("id_produto", "categoria_produto"), "id_produto").groupBy("categoria_produto")
    return by.agg(F.sum("receita").alias("receita_total"), F.sum("itens").alias("total_itens"))


def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart loaded into a database, dimensions first; counts of source and table, as the catalog lists them."""
    m = mart_of(spark, sf_dir)._asdict()
    tables = dict(zip(TABLES, m.values()))
    ordered = {name: tables[name] for name in (*TABLES[1:], TABLES[0])}
    return load_database(spark, DATABASE, ordered, {"fato_vendas": ["ano_mes"]})


#: Run dates of the snapshots: the last days of the years of the period.
RUN_DATES = tuple(dt.date(y, 12, 31) for y in range(1996, 2001))


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: snapshots of the KPIs at several run dates, one run twice, read back with the change between runs."""
    job = Job(spark, sf_dir)
    orders = materialize(spark, job.orders, "orders")
    path = _new(spark, "kpis")
    for run in (*RUN_DATES, RUN_DATES[2]):
        append_snapshot(R.kpi_snapshot(orders.where(F.col("data") <= F.lit(run)), run), path)
    return run_changes(spark.read.parquet(path), "data_calculo", ["receita_total", "total_pedidos", "ticket_medio"])


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the month table after the orders of status P of 1998 and all orders of January 1996 were taken back; the
    months that a refresh rebuilt, and those it left as they were."""
    orders = materialize(spark, Job(spark, sf_dir).orders, "orders")
    path = _new(spark, "months")
    refresh_changed(orders, path, "ano_mes", R.month_summary)
    taken = ((F.year("data") == 1998) & F.coalesce(F.col("status_pedido") == "P", F.lit(False))) | (F.col("ano_mes") == "1996-01")
    report = refresh_changed(orders.where(~taken), path, "ano_mes", R.month_summary)
    return spark.read.parquet(path).join(report, "ano_mes", "full_outer")


CUTOFF = dt.datetime(2000, 10, 2, 12)


def retention_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log stored by day, an hour of the day given by the key; records before noon of the border day go."""
    log = Job(spark, sf_dir).change_log
    at = F.timestamp_add("HOUR", (F.col("chave") % 24).cast("int"), F.col("data_consulta"))
    path = _new(spark, "log")
    log.withColumn("data_consulta", at).withColumn("dia", F.to_date("data_consulta")).hint("rebalance", "dia").write.partitionBy("dia").parquet(path)
    retain_days(spark, path, CUTOFF, "dia", "data_consulta")
    return spark.read.parquet(path).select("dia", "operacao", "chave", "data_consulta")


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state report by the table function, by the statement with a parameter and from the view, and the
    months that fell from the month view, all by SQL text over the stored mart."""
    params = driver_params()
    register_views(spark, mart_of(spark, sf_dir), params)
    report = state_report_sql(spark, params.focus_state)
    rest = spark.sql(f"""
        WITH quedas AS (SELECT * FROM vw_resumo_vendas_mensal WHERE variacao_pct < 0)
        SELECT 'funcao' AS origem, estado_cliente AS chave, receita_total, total_pedidos FROM relatorio_estado('{params.focus_state}')
        UNION ALL SELECT 'visao', estado_cliente, CAST(receita_total AS DECIMAL(15,2)), total_pedidos FROM vw_resumo_vendas_estado
        UNION ALL SELECT 'queda', ano_mes, CAST(receita_total AS DECIMAL(15,2)), total_pedidos FROM quedas""")
    return rest.unionByName(report.select(F.lit("parametro").alias("origem"), F.col("estado_cliente").alias("chave"), "receita_total", "total_pedidos"))


def br_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the month series written with decimal commas and read back, doubles to the last bit."""
    rows = Job(spark, sf_dir).growth
    path = _new(spark, "months-br")
    write_csv_br(rows, path)
    return read_csv_br_exact(spark, path, rows.schema)


KEYS = (
    schema_gate, csv_quarantine, rates_degraded, stored_last_quarters, stored_categories_of_december, catalog_load,
    snapshot_history, incremental_refresh, retention_by_day, sql_surface, br_round_trip,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def typed(f):
        return lambda spark, sf_dir: finish(f(spark, sf_dir))

    return {f.__name__: typed(f) for f in KEYS}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _gate_oracle() -> str:
    there = [name for name in DECLARED if name != "refunds"]
    expected = _values((name, c, t) for name in there for c, t in declared_fields(name))
    counted = " UNION ALL ".join(
        f"SELECT '{name}' AS tabela, '{c}' AS coluna, count(*) AS linhas, count(*) FILTER (WHERE {c} IS NULL) AS nulos FROM {name}"
        for name in there for c in required(name))
    return f"""
WITH declarado(tabela, coluna, esperado) AS (VALUES {expected}),
achado AS (
  SELECT table_name AS tabela, column_name AS coluna,
         CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS encontrado
  FROM duckdb_columns() WHERE table_name IN (SELECT tabela FROM declarado)),
contado AS ({counted})
SELECT coalesce(d.tabela, a.tabela) AS tabela, coalesce(d.coluna, a.coluna) AS coluna, d.esperado, a.encontrado,
       CASE WHEN d.coluna IS NULL THEN 'a mais' WHEN a.coluna IS NULL THEN 'falta' WHEN d.esperado = a.encontrado THEN 'ok' ELSE 'outro tipo' END AS situacao,
       c.linhas, c.nulos
FROM declarado d FULL JOIN achado a ON d.tabela = a.tabela AND d.coluna = a.coluna
LEFT JOIN contado c ON c.tabela = coalesce(d.tabela, a.tabela) AND c.coluna = coalesce(d.coluna, a.coluna)
UNION ALL SELECT 'refunds', NULL, NULL, NULL, 'sem arquivo', NULL, NULL"""


def oracle() -> dict[str, str]:
    return {
        "schema_gate": _gate_oracle(),
        "csv_quarantine": """
WITH lidas AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' AND left(o_orderpriority, 1) = '4' THEN 'registro'
                 WHEN o_orderstatus = 'P' AND left(o_orderpriority, 1) = '1' THEN 'o_totalprice,o_orderdate'
                 WHEN o_orderstatus = 'F' AND left(o_orderpriority, 1) = '5' THEN 'o_totalprice'
                 WHEN o_orderstatus = 'O' AND left(o_orderpriority, 1) = '2' THEN 'o_orderdate' ELSE '' END AS motivo FROM orders)
SELECT 'aceita' AS situacao, '' AS motivo, count(*) AS linhas, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS valor,
       CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS primeira_data FROM lidas WHERE motivo = ''
UNION ALL SELECT 'rejeitada', motivo, count(*), NULL, NULL FROM lidas WHERE motivo <> '' GROUP BY motivo""",
        "rates_degraded": PREFIX + f"""
, diario AS (
  SELECT CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS q FROM lineitem
  WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1),
mensal AS (SELECT strftime(d, '%Y-%m') AS ano_mes, avg(q) AS taxa FROM diario WHERE year(d) NOT IN (1998, 1999) GROUP BY 1),
literal(ano_mes, dolar) AS (VALUES {_values(MOVED)})
SELECT s.ano_mes, round(coalesce(l.dolar, m.taxa), 6) AS taxa,
       CASE WHEN l.dolar IS NOT NULL THEN 'tabela' WHEN m.taxa IS NOT NULL THEN 'json' END AS origem
FROM spine s LEFT JOIN mensal m USING (ano_mes) LEFT JOIN literal l USING (ano_mes)""",
        "stored_last_quarters": PREFIX + """
SELECT CAST(year(data) AS BIGINT) AS ano, CAST(sum(valor_total_item) AS DOUBLE) AS receita_total,
       count(DISTINCT id_pedido) AS total_pedidos, count(id_item_pedido) AS total_itens
FROM fato WHERE quarter(data) = 4 GROUP BY 1""",
        "stored_categories_of_december": PREFIX + """
SELECT p.categoria_produto, CAST(sum(f.valor_total_item) AS DOUBLE) AS receita_total, count(*) AS total_itens
FROM fato f JOIN prod p ON f.id_produto = p.id_produto WHERE month(f.data) = 12 GROUP BY 1""",
        "catalog_load": PREFIX + """
, contado AS (
  SELECT 1 AS ordem, 'dim_clientes' AS tabela, count(*) AS n FROM cli UNION ALL SELECT 2, 'dim_produtos', count(*) FROM prod
  UNION ALL SELECT 3, 'dim_vendedores', count(*) FROM vend UNION ALL SELECT 4, 'dim_tempo', count(*) FROM tempo
  UNION ALL SELECT 5, 'fato_vendas', count(*) FROM fato)
SELECT CAST(ordem AS BIGINT) AS ordem, tabela, n AS linhas_origem, n AS linhas_carregadas, true AS confere FROM contado""",
        "snapshot_history": PREFIX + f"""
, medidas AS (
  SELECT d AS data_calculo, CAST(sum(receita_itens) AS DECIMAL(15,2)) AS receita_total, count(*) AS total_pedidos,
         round(CAST(sum(receita_itens) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0), 2) AS ticket_medio
  FROM pedidos JOIN (VALUES {", ".join(f"(DATE '{d}')" for d in RUN_DATES)}) r(d) ON data <= d GROUP BY d)
SELECT CAST(data_calculo AS VARCHAR) AS data_calculo, CAST(receita_total AS DOUBLE) AS receita_total, total_pedidos, ticket_medio,
       CAST(receita_total - lag(receita_total) OVER w AS DOUBLE) AS receita_total_variacao,
       total_pedidos - lag(total_pedidos) OVER w AS total_pedidos_variacao, ticket_medio - lag(ticket_medio) OVER w AS ticket_medio_variacao
FROM medidas WINDOW w AS (ORDER BY data_calculo)""",
        "incremental_refresh": PREFIX + """
, ficam AS (SELECT *, coalesce((year(data) = 1998 AND status_pedido = 'P') OR ano_mes = '1996-01', false) AS sai FROM pedidos),
meses AS (
  SELECT ano_mes, CAST(sum(receita_itens) AS DECIMAL(15,2)) AS receita_total, count(*) AS total_pedidos,
         round(CAST(sum(receita_itens) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0), 2) AS ticket_medio
  FROM ficam WHERE NOT sai GROUP BY ano_mes)
SELECT t.ano_mes, CAST(m.receita_total AS DOUBLE) AS receita_total, m.total_pedidos, m.ticket_medio,
       CASE WHEN m.ano_mes IS NULL THEN 'removida' WHEN t.saem > 0 THEN 'refeita' ELSE 'igual' END AS situacao
FROM (SELECT ano_mes, count(*) FILTER (WHERE sai) AS saem FROM ficam GROUP BY ano_mes) t LEFT JOIN meses m USING (ano_mes)""",
        "retention_by_day": PREFIX + f"""
, horas AS (SELECT operacao, chave, data_consulta + to_hours(CAST(chave % 24 AS INTEGER)) AS em FROM clog)
SELECT CAST(CAST(em AS DATE) AS VARCHAR) AS dia, operacao, chave, strftime(em, '%Y-%m-%d %H:%M:%S') AS data_consulta
FROM horas WHERE em >= TIMESTAMP '{CUTOFF}'""",
        "sql_surface": PREFIX + """
, estados AS (SELECT estado_cliente, CAST(CAST(sum(receita_itens) AS DECIMAL(15,2)) AS DOUBLE) AS r, count(*) AS n FROM pc GROUP BY 1),
meses AS (SELECT ano_mes, sum(receita_itens) AS r, count(*) AS n, lag(sum(receita_itens)) OVER (ORDER BY ano_mes) AS antes FROM pedidos GROUP BY ano_mes)
SELECT o.origem, e.estado_cliente AS chave, e.r AS receita_total, e.n AS total_pedidos
FROM estados e CROSS JOIN (VALUES ('funcao'), ('parametro')) o(origem) WHERE e.estado_cliente = 'NATION_7'
UNION ALL SELECT 'visao', estado_cliente, r, n FROM estados
UNION ALL SELECT 'queda', ano_mes, CAST(CAST(r AS DECIMAL(15,2)) AS DOUBLE), n FROM meses WHERE r < antes""",
        "br_round_trip": PREFIX + """
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal, crescimento_mom_pct FROM growth""",
    }
