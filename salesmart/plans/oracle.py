"""DuckDB twins of the registered queries, for the driver's correctness check at sf0.01.

Every statement starts with the same adapter CTE (driver tables -> fact ->
period sales -> per-order facts), mirroring ``sources.tpch`` and
``operators.orders``; each key only adds its report part. The rates, counts and
dashboards of orders are written from the fact's rows alone, with
``COUNT(DISTINCT CASE ...)``, not from the per-order table that the jobs use.
Parameters are the values of ``params.driver_params``: period
1996-01-01..2000-12-31, delivered status 'F', critical below 100000 with freight
over 5 %, late ranking from 450 orders, focus state NATION_7, top 10.
"""

from __future__ import annotations

START, END = "DATE '1996-01-01'", "DATE '2000-12-31'"

PREFIX = f"""
WITH
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS ts_compra,
         o_orderdate + to_days(365 * TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS ts_estimada
  FROM orders WHERE o_orderkey IS NOT NULL),
c AS (
  SELECT c_custkey AS customer_id, c_custkey AS id_cliente,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS cep_prefixo_cliente,
         lower(concat_ws(' ', c_mktsegment, n_name)) AS cidade_cliente, n_name AS estado_cliente
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
i AS (
  SELECT l_orderkey AS order_id, l_linenumber AS id_item_pedido, l_partkey AS id_produto,
         l_suppkey AS id_vendedor, l_shipdate AS ts_envio,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS valor_produto,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS valor_frete
  FROM lineitem),
j AS (
  SELECT o.*, o.customer_id AS id_cliente, c.cep_prefixo_cliente, c.cidade_cliente, c.estado_cliente,
         i.id_item_pedido, i.id_produto, i.id_vendedor, i.valor_produto, i.valor_frete,
         max(i.ts_envio) OVER (PARTITION BY o.order_id) AS ts_entrega
  FROM o LEFT JOIN c ON o.customer_id = c.customer_id LEFT JOIN i ON o.order_id = i.order_id),
dd AS (
  SELECT *,
    CAST(floor(date_diff('microsecond', ts_compra, ts_entrega) / 86400000000.0) AS BIGINT) AS tempo_entrega_dias,
    CAST(floor(date_diff('microsecond', ts_compra, ts_estimada) / 86400000000.0) AS BIGINT) AS prazo_estimado_dias,
    CAST(floor(date_diff('microsecond', ts_estimada, ts_entrega) / 86400000000.0) AS BIGINT) AS atraso_entrega_dias
  FROM j),
fato AS (
  SELECT order_id AS id_pedido, id_item_pedido, id_produto, id_vendedor, id_cliente,
         CAST(ts_compra AS DATE) AS data, order_status AS status_pedido,
         valor_produto, valor_frete, valor_produto + valor_frete AS valor_total_item,
         tempo_entrega_dias, prazo_estimado_dias, atraso_entrega_dias,
         CASE WHEN order_status IS DISTINCT FROM 'F' OR atraso_entrega_dias IS NULL THEN NULL
              ELSE CAST(atraso_entrega_dias > 0 AS INTEGER) END AS entregue_com_atraso,
         CASE WHEN order_status IS NOT DISTINCT FROM 'F' THEN 1 ELSE 0 END AS pedido_entregue,
         cep_prefixo_cliente, cidade_cliente, estado_cliente, ts_compra, ts_entrega, ts_estimada
  FROM dd),
cli AS (
  SELECT DISTINCT c.id_cliente, c.cep_prefixo_cliente, c.cidade_cliente, c.estado_cliente
  FROM o LEFT JOIN c ON o.customer_id = c.customer_id WHERE c.id_cliente IS NOT NULL),
prod AS (
  SELECT k.id_produto, p.p_type AS categoria_produto
  FROM (SELECT DISTINCT id_produto FROM fato WHERE id_produto IS NOT NULL) k
  LEFT JOIN part p ON k.id_produto = p.p_partkey),
vend AS (
  SELECT k.id_vendedor, n.n_name AS estado_vendedor
  FROM (SELECT DISTINCT id_vendedor FROM fato WHERE id_vendedor IS NOT NULL) k
  LEFT JOIN supplier s ON k.id_vendedor = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
tempo AS (
  SELECT data, year(data) AS ano, month(data) AS mes, monthname(data) AS nome_mes,
         quarter(data) AS trimestre, strftime(data, '%Y-%m') AS ano_mes
  FROM (SELECT DISTINCT data FROM fato WHERE data IS NOT NULL)),
sales AS (SELECT * FROM fato WHERE data BETWEEN {START} AND {END}),
p0 AS (
  SELECT id_pedido, min(id_cliente) AS id_cliente, min(data) AS data, min(status_pedido) AS status_pedido,
         sum(valor_total_item) AS receita_itens, sum(valor_frete) AS frete_itens,
         count(valor_total_item) AS n_valores, count(id_item_pedido) AS n_itens,
         max(entregue_com_atraso) AS entregue_com_atraso, max(pedido_entregue) AS pedido_entregue,
         sum(tempo_entrega_dias) AS soma_tempo_itens, count(tempo_entrega_dias) AS n_tempo_itens,
         avg(tempo_entrega_dias) AS tempo_medio_entrega_dias
  FROM sales GROUP BY id_pedido),
p1 AS (
  SELECT *, coalesce(receita_itens, 0) AS valor_pedido, coalesce(frete_itens, 0) AS frete_pedido,
         strftime(data, '%Y-%m') AS ano_mes
  FROM p0),
pedidos AS (
  SELECT *,
    CASE WHEN valor_pedido > 0 THEN CAST(frete_pedido AS DOUBLE) / CAST(valor_pedido AS DOUBLE) * 100 END
      AS peso_frete_pedido_pct,
    CASE WHEN valor_pedido > 0 AND valor_pedido < 100000 AND frete_pedido > 0.05 * valor_pedido THEN 1 ELSE 0 END
      AS pedido_critico
  FROM p1),
pc AS (
  SELECT p.*, cli.estado_cliente, cli.cidade_cliente FROM pedidos p JOIN cli USING (id_cliente)),
monthly AS (
  SELECT ano_mes, sum(receita_itens) AS receita_mensal FROM pedidos GROUP BY ano_mes),
growth AS (
  SELECT ano_mes, receita_mensal,
    (CAST(receita_mensal AS DOUBLE) / CAST(lag(receita_mensal) OVER (ORDER BY ano_mes) AS DOUBLE) - 1) * 100
      AS crescimento_mom_pct
  FROM monthly WHERE receita_mensal > 0),
spine AS (
  SELECT strftime(m, '%Y-%m') AS ano_mes
  FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH) t(m)),
rev_spine AS (
  SELECT s.ano_mes, coalesce(m.receita_mensal, 0) AS receita_mensal
  FROM spine s LEFT JOIN monthly m USING (ano_mes)),
rates AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS ano_mes, avg(l_quantity) AS cotacao
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN {START} AND {END} GROUP BY 1),
rates_filled AS (
  SELECT s.ano_mes, coalesce(
    last_value(r.cotacao IGNORE NULLS) OVER (ORDER BY s.ano_mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(r.cotacao IGNORE NULLS) OVER (ORDER BY s.ano_mes ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    AS cotacao
  FROM spine s LEFT JOIN rates r USING (ano_mes)),
numbered AS (
  SELECT ano_mes, receita_mensal, row_number() OVER (ORDER BY ano_mes) AS mes_num FROM monthly),
fit AS (
  SELECT regr_slope(CAST(receita_mensal AS DOUBLE), CAST(mes_num AS DOUBLE)) AS inclinacao,
         regr_intercept(CAST(receita_mensal AS DOUBLE), CAST(mes_num AS DOUBLE)) AS intercepto,
         regr_r2(CAST(receita_mensal AS DOUBLE), CAST(mes_num AS DOUBLE)) AS r2,
         count(*) AS n_meses, max(mes_num) AS ultimo_mes_num, max(ano_mes) AS ultimo_ano_mes
  FROM numbered),
act_old AS (
  SELECT id_cliente, count(*) AS n_pedidos, CAST(min(data) AS VARCHAR) AS primeiro_pedido,
         CAST(max(data) AS VARCHAR) AS ultimo_pedido
  FROM (SELECT id_pedido, min(id_cliente) AS id_cliente, min(data) AS data FROM fato
        WHERE data BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY id_pedido)
  WHERE id_cliente IS NOT NULL GROUP BY id_cliente),
act_new AS (
  SELECT id_cliente, count(*) AS n_pedidos, CAST(min(data) AS VARCHAR) AS primeiro_pedido,
         CAST(max(data) AS VARCHAR) AS ultimo_pedido
  FROM (SELECT id_pedido, min(id_cliente) AS id_cliente, min(data) AS data FROM fato
        WHERE data BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY id_pedido)
  WHERE id_cliente IS NOT NULL GROUP BY id_cliente),
clog AS (
  SELECT CASE WHEN a.id_cliente IS NULL THEN 'INSERT' WHEN b.id_cliente IS NULL THEN 'DELETE' ELSE 'UPDATE' END
           AS operacao,
         'clientes_ativos' AS tabela_afetada, coalesce(a.id_cliente, b.id_cliente) AS chave,
         CASE WHEN a.id_cliente IS NOT NULL THEN CAST(to_json({{'id_cliente': a.id_cliente, 'n_pedidos': a.n_pedidos,
           'primeiro_pedido': a.primeiro_pedido, 'ultimo_pedido': a.ultimo_pedido}}) AS VARCHAR) END AS dados_anteriores,
         CASE WHEN b.id_cliente IS NOT NULL THEN CAST(to_json({{'id_cliente': b.id_cliente, 'n_pedidos': b.n_pedidos,
           'primeiro_pedido': b.primeiro_pedido, 'ultimo_pedido': b.ultimo_pedido}}) AS VARCHAR) END AS dados_novos,
         CAST(coalesce(b.ultimo_pedido, a.ultimo_pedido) AS TIMESTAMP) AS data_consulta
  FROM act_old a FULL OUTER JOIN act_new b ON a.id_cliente = b.id_cliente
  WHERE a.id_cliente IS NULL OR b.id_cliente IS NULL
     OR (a.n_pedidos, a.primeiro_pedido, a.ultimo_pedido) IS DISTINCT FROM (b.n_pedidos, b.primeiro_pedido, b.ultimo_pedido))
"""


def _r(num: str, den: str, scale: str = " * 100") -> str:
    """Double ratio with a NULL guard, same operation order as ``reports.ratio``."""
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0){scale}"


ENTREGUE, ATRASADO = "pedido_entregue = 1", "pedido_entregue = 1 AND entregue_com_atraso = 1"


def _of(condition: str) -> str:
    """Orders of the fact's rows that meet a condition."""
    return f"count(DISTINCT CASE WHEN {condition} THEN id_pedido END)"


def _brl(x: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST(round(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)), ',.', '.,')"


def _pct(x: str) -> str:
    return f"replace(format('{{:.2f}}', CAST(round(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)), '.', ',') || '%'"


def _int(x: str) -> str:
    return f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


def _top(value: str, key: str, k: int = 10) -> str:
    return f"ORDER BY {value} DESC NULLS LAST, {key} ASC NULLS LAST LIMIT {k}"


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


BODIES: dict[str, str] = {
    "kpi_totals": f"""
SELECT CAST(sum(receita_itens) AS DOUBLE) AS receita_total, count(*) AS total_pedidos,
       {_r('sum(receita_itens)', 'count(*)', '')} AS ticket_medio,
       {_r('sum(receita_itens)', 'sum(n_valores)', '')} AS valor_medio_item
FROM pedidos""",
    "order_facts": """
SELECT id_pedido, id_cliente, CAST(data AS VARCHAR) AS data, status_pedido, CAST(valor_pedido AS DOUBLE) AS valor_pedido,
       CAST(frete_pedido AS DOUBLE) AS frete_pedido, n_itens, CAST(entregue_com_atraso AS BIGINT) AS entregue_com_atraso,
       CAST(pedido_entregue AS BIGINT) AS pedido_entregue, round(tempo_medio_entrega_dias, 6) AS tempo_medio_entrega_dias,
       round(peso_frete_pedido_pct, 6) AS peso_frete_pedido_pct, CAST(pedido_critico AS BIGINT) AS pedido_critico
FROM pedidos""",
    "delivery_days": """
SELECT id_pedido, min(tempo_entrega_dias) AS tempo_entrega_dias, min(prazo_estimado_dias) AS prazo_estimado_dias,
       min(atraso_entrega_dias) AS atraso_entrega_dias
FROM fato GROUP BY id_pedido""",
    "late_flag": """
SELECT id_pedido, status_pedido, CAST(max(entregue_com_atraso) AS BIGINT) AS entregue_com_atraso,
       CAST(max(pedido_entregue) AS BIGINT) AS pedido_entregue
FROM fato GROUP BY id_pedido, status_pedido""",
    "item_value": """
SELECT id_pedido, CAST(id_item_pedido AS BIGINT) AS id_item_pedido, CAST(valor_produto AS DOUBLE) AS valor_produto,
       CAST(valor_frete AS DOUBLE) AS valor_frete, CAST(valor_total_item AS DOUBLE) AS valor_total_item
FROM fato WHERE id_item_pedido IS NOT NULL""",
    "item_freight_pct": f"""
SELECT id_pedido, CAST(id_item_pedido AS BIGINT) AS id_item_pedido,
       round(CASE WHEN valor_produto > 0 THEN {_r('valor_frete', 'valor_produto')} END, 6) AS peso_frete_pct
FROM fato WHERE id_item_pedido IS NOT NULL""",
    "time_parts": """
SELECT CAST(data AS VARCHAR) AS data, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes, nome_mes,
       CAST(trimestre AS BIGINT) AS trimestre, ano_mes FROM tempo""",
    "dim_tempo": """
SELECT CAST(data AS VARCHAR) AS data, CAST(ano AS BIGINT) AS ano, CAST(mes AS BIGINT) AS mes, nome_mes,
       CAST(trimestre AS BIGINT) AS trimestre, ano_mes FROM tempo""",
    "dim_clientes": "SELECT id_cliente, cep_prefixo_cliente, cidade_cliente, estado_cliente FROM cli",
    "dim_produtos": """
SELECT k.id_produto, p.p_type AS categoria_produto, CAST(length(p.p_name) AS BIGINT) AS tamanho_nome_produto,
       CAST(length(concat_ws(' ', p.p_name, p.p_brand, p.p_type)) AS BIGINT) AS tamanho_descricao_produto,
       CAST(p.p_size AS BIGINT) AS peso_produto_g
FROM (SELECT DISTINCT id_produto FROM fato WHERE id_produto IS NOT NULL) k
LEFT JOIN part p ON k.id_produto = p.p_partkey""",
    "dim_vendedores": """
SELECT k.id_vendedor, lpad(CAST(s.s_nationkey AS VARCHAR), 5, '0') AS cep_prefixo_vendedor,
       lower(n.n_name) AS cidade_vendedor, n.n_name AS estado_vendedor
FROM (SELECT DISTINCT id_vendedor FROM fato WHERE id_vendedor IS NOT NULL) k
LEFT JOIN supplier s ON k.id_vendedor = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "analytic_base": f"""
SELECT id_pedido AS order_id, id_cliente AS customer_id, status_pedido AS order_status,
       {_ts('ts_compra')} AS order_purchase_timestamp, {_ts('ts_entrega')} AS order_delivered_customer_date,
       {_ts('ts_estimada')} AS order_estimated_delivery_date, cidade_cliente AS customer_city,
       estado_cliente AS customer_state, CAST(id_item_pedido AS BIGINT) AS order_item_id, id_produto AS product_id,
       id_vendedor AS seller_id, CAST(valor_produto AS DOUBLE) AS price, CAST(valor_frete AS DOUBLE) AS freight_value,
       CAST(valor_total_item AS DOUBLE) AS valor_total_item, strftime(ts_compra, '%Y-%m') AS ano_mes,
       tempo_entrega_dias, prazo_estimado_dias, atraso_entrega_dias,
       CAST(entregue_com_atraso AS BIGINT) AS entregue_com_atraso, CAST(pedido_entregue AS BIGINT) AS pedido_entregue
FROM fato""",
    "sales_base": """
SELECT f.id_pedido, CAST(f.id_item_pedido AS BIGINT) AS id_item_pedido, f.id_cliente, f.id_produto, f.id_vendedor,
       CAST(f.data AS VARCHAR) AS data, t.ano_mes, f.status_pedido, CAST(f.valor_total_item AS DOUBLE) AS valor_total_item,
       CAST(f.valor_frete AS DOUBLE) AS valor_frete, cli.estado_cliente, cli.cidade_cliente, prod.categoria_produto,
       vend.estado_vendedor
FROM fato f LEFT JOIN cli ON f.id_cliente = cli.id_cliente LEFT JOIN prod ON f.id_produto = prod.id_produto
LEFT JOIN vend ON f.id_vendedor = vend.id_vendedor JOIN tempo t ON f.data = t.data
WHERE t.ano_mes BETWEEN '1996-01' AND '2000-12'""",
    "api_base": """
SELECT s.id_pedido, CAST(s.id_item_pedido AS BIGINT) AS id_item_pedido, CAST(s.data AS VARCHAR) AS data, cli.estado_cliente,
       CAST(coalesce(s.valor_total_item, 0) AS DOUBLE) AS valor_total_item,
       CAST(coalesce(s.valor_frete, 0) AS DOUBLE) AS valor_frete
FROM sales s JOIN cli ON s.id_cliente = cli.id_cliente WHERE cli.estado_cliente IS NOT NULL""",
    "orders_dedup": f"""
SELECT id_pedido AS order_id, id_cliente AS customer_id, status_pedido AS order_status,
       {_ts('ts_compra')} AS order_purchase_timestamp,
       CAST(id_item_pedido AS BIGINT) AS order_item_id, id_produto AS product_id, id_vendedor AS seller_id,
       CAST(valor_produto AS DOUBLE) AS price, CAST(valor_frete AS DOUBLE) AS freight_value
FROM (SELECT *, row_number() OVER (PARTITION BY id_pedido ORDER BY id_item_pedido NULLS FIRST, id_produto NULLS FIRST,
        id_vendedor NULLS FIRST, valor_produto NULLS FIRST, valor_frete NULLS FIRST) AS rn FROM fato)
WHERE rn = 1""",
    "table_counts": """
SELECT 'dim_clientes' AS tabela, count(*) AS quantidade FROM cli
UNION ALL SELECT 'dim_produtos', count(*) FROM prod
UNION ALL SELECT 'dim_vendedores', count(*) FROM vend
UNION ALL SELECT 'dim_tempo', count(*) FROM tempo
UNION ALL SELECT 'fato_vendas', count(*) FROM fato""",
    "profile_shape": """
SELECT 'fato_vendas' AS tabela, count(*) AS linhas, CAST(15 AS BIGINT) AS colunas FROM fato
UNION ALL SELECT 'dim_clientes', count(*), 4 FROM cli
UNION ALL SELECT 'dim_produtos', count(*), 5 FROM prod
UNION ALL SELECT 'dim_vendedores', count(*), 4 FROM vend
UNION ALL SELECT 'dim_tempo', count(*), 6 FROM tempo""",
    "profile_duplicates": """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS linhas_duplicadas, count(*) AS linhas_distintas
FROM (SELECT count(*) AS n FROM fato GROUP BY id_pedido, id_item_pedido, id_produto, id_vendedor, id_cliente, data,
      status_pedido, valor_produto, valor_frete, valor_total_item, tempo_entrega_dias, prazo_estimado_dias,
      atraso_entrega_dias, entregue_com_atraso, pedido_entregue)""",
    "critical_orders": f"""
SELECT count(*) FILTER (WHERE v > 0 AND v < 100000 AND f > 0.05 * v) AS pedidos_criticos, count(*) AS total_pedidos,
       {_r('count(*) FILTER (WHERE v > 0 AND v < 100000 AND f > 0.05 * v)', 'count(*)')} AS pct_criticos
FROM (SELECT id_pedido, sum(valor_total_item) AS v, sum(valor_frete) AS f FROM sales GROUP BY id_pedido)""",
    "monthly_revenue": "SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal FROM monthly",
    "late_rate": f"""
SELECT {_of(ENTREGUE)} AS pedidos_entregues, {_of(ATRASADO)} AS pedidos_atrasados,
       {_of('pedido_entregue = 1 AND entregue_com_atraso = 0')} AS pedidos_no_prazo,
       {_of('pedido_entregue = 1 AND entregue_com_atraso IS NULL')} AS pedidos_sem_data,
       {_r(_of(ATRASADO), _of(ENTREGUE))} AS taxa_atraso_pct
FROM sales""",
    "late_rate_known": f"""
SELECT count(entregue_com_atraso) AS pedidos_com_flag, CAST(sum(entregue_com_atraso) AS BIGINT) AS pedidos_atrasados,
       {_r('sum(entregue_com_atraso)', 'count(entregue_com_atraso)')} AS taxa_atraso_pct
FROM pedidos WHERE pedido_entregue = 1""",
    "kpi_delivery": f"""
SELECT count(*) AS total_pedidos, count(*) FILTER (WHERE pedido_entregue = 1) AS pedidos_entregues,
       {_r('count(*) FILTER (WHERE pedido_entregue = 1)', 'count(*)')} AS pct_entregues
FROM pedidos""",
    "kpi_freight": f"""
SELECT round(avg(peso_frete_pedido_pct), 6) AS peso_frete_medio_pct,
       {_r('sum(frete_itens)', 'sum(receita_itens)')} AS peso_frete_total_pct
FROM pedidos""",
    "executive_dashboard": f"""
SELECT CAST(sum(valor_total_item) AS DOUBLE) AS receita_total, count(DISTINCT id_pedido) AS total_pedidos,
       {_r('sum(valor_total_item)', 'count(DISTINCT id_pedido)', '')} AS ticket_medio,
       {_r('sum(valor_frete)', 'sum(valor_total_item)')} AS peso_frete_pct,
       {_r(_of(ATRASADO), _of(ENTREGUE))} AS taxa_atraso_pct,
       (SELECT count(*) FILTER (WHERE v > 0 AND v < 100000 AND f > 0.05 * v)
        FROM (SELECT id_pedido, sum(valor_total_item) AS v, sum(valor_frete) AS f FROM sales GROUP BY id_pedido))
         AS pedidos_criticos
FROM sales""",
    "revenue_by_state": f"""
SELECT estado_cliente, CAST(sum(receita_itens) AS DOUBLE) AS receita_total FROM pc GROUP BY estado_cliente
{_top('sum(receita_itens)', 'estado_cliente')}""",
    "orders_by_city": f"""
SELECT cli.cidade_cliente, count(DISTINCT id_pedido) AS total_pedidos FROM sales JOIN cli USING (id_cliente)
GROUP BY cli.cidade_cliente {_top('count(DISTINCT id_pedido)', 'cli.cidade_cliente')}""",
    "city_normalized": f"""
SELECT cidade_normalizada, count(*) AS total_pedidos
FROM (SELECT coalesce(map_extract(MAP {{'sao paulo': 'São Paulo', 'rio de janeiro': 'Rio de Janeiro',
        'belo horizonte': 'Belo Horizonte', 'brasilia': 'Brasília', 'curitiba': 'Curitiba', 'campinas': 'Campinas',
        'porto alegre': 'Porto Alegre', 'salvador': 'Salvador', 'guarulhos': 'Guarulhos',
        'sao bernardo do campo': 'São Bernardo do Campo'}}, lower(trim(cidade_cliente)))[1], lower(trim(cidade_cliente)))
        AS cidade_normalizada FROM pc)
GROUP BY cidade_normalizada {_top('count(*)', 'cidade_normalizada')}""",
    "revenue_by_city": f"""
SELECT cidade_cliente, CAST(sum(receita_itens) AS DOUBLE) AS receita_total FROM pc GROUP BY cidade_cliente
{_top('sum(receita_itens)', 'cidade_cliente')}""",
    "revenue_by_seller": f"""
SELECT s.id_vendedor, CAST(sum(s.valor_total_item) AS DOUBLE) AS receita_total
FROM sales s JOIN vend v ON s.id_vendedor = v.id_vendedor GROUP BY s.id_vendedor
{_top('sum(s.valor_total_item)', 's.id_vendedor')}""",
    "revenue_by_category": f"""
SELECT p.categoria_produto, CAST(sum(s.valor_total_item) AS DOUBLE) AS receita_total
FROM sales s JOIN prod p ON s.id_produto = p.id_produto GROUP BY p.categoria_produto
{_top('sum(s.valor_total_item)', 'p.categoria_produto')}""",
    "items_by_category": f"""
SELECT p.categoria_produto, count(*) AS total_itens_vendidos
FROM sales s JOIN prod p ON s.id_produto = p.id_produto GROUP BY p.categoria_produto
{_top('count(*)', 'p.categoria_produto')}""",
    "ticket_by_state": f"""
SELECT estado_cliente, CAST(sum(receita_itens) AS DOUBLE) AS receita_total, count(*) AS total_pedidos,
       {_r('sum(receita_itens)', 'count(*)', '')} AS ticket_medio
FROM pc GROUP BY estado_cliente""",
    "freight_share_by_state": f"""
SELECT estado_cliente, CAST(sum(frete_itens) AS DOUBLE) AS frete_total, CAST(sum(receita_itens) AS DOUBLE) AS receita_total,
       count(*) AS total_pedidos, {_r('sum(frete_itens)', 'sum(receita_itens)')} AS frete_pct
FROM pc GROUP BY estado_cliente""",
    "late_rate_by_state": f"""
SELECT cli.estado_cliente, count(DISTINCT id_pedido) AS total_pedidos, {_of(ENTREGUE)} AS pedidos_entregues,
       {_of(ATRASADO)} AS pedidos_atrasados, {_r(_of(ATRASADO), _of(ENTREGUE))} AS taxa_atraso_pct
FROM sales JOIN cli USING (id_cliente) GROUP BY cli.estado_cliente HAVING count(DISTINCT id_pedido) >= 450""",
    "delivery_time_by_state": f"""
SELECT cli.estado_cliente, round({_r('sum(tempo_entrega_dias)', 'count(tempo_entrega_dias)', '')}, 6) AS tempo_medio_entrega_dias
FROM sales JOIN cli USING (id_cliente) WHERE tempo_entrega_dias IS NOT NULL GROUP BY cli.estado_cliente""",
    "delivery_time_by_state_orders": f"""
SELECT estado_cliente, count(*) AS pedidos_entregues, CAST(sum(entregue_com_atraso) AS BIGINT) AS pedidos_atrasados,
       round(avg(tempo_medio_entrega_dias), 6) AS tempo_medio_entrega_dias,
       {_r('sum(entregue_com_atraso)', 'count(*)')} AS taxa_atraso_pct
FROM pc WHERE pedido_entregue = 1 GROUP BY estado_cliente""",
    "revenue_by_status": """
SELECT status_pedido, CAST(sum(receita_itens) AS DOUBLE) AS receita_total, count(*) AS total_pedidos
FROM pedidos GROUP BY status_pedido""",
    "concentration_states": f"""
SELECT posicao, estado_cliente, receita_total, participacao_pct,
       round(sum(participacao_pct) OVER (ORDER BY posicao ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS participacao_acumulada_pct
FROM (SELECT row_number() OVER (ORDER BY r DESC, estado_cliente) AS posicao, estado_cliente,
             CAST(r AS DOUBLE) AS receita_total, {_r('r', '(SELECT sum(receita_itens) FROM pedidos)')} AS participacao_pct
      FROM (SELECT estado_cliente, sum(receita_itens) AS r FROM pc WHERE estado_cliente IS NOT NULL
            GROUP BY estado_cliente {_top('sum(receita_itens)', 'estado_cliente', 5)}))""",
    "concentration_sellers": f"""
SELECT posicao, id_vendedor, receita_total, participacao_pct,
       round(sum(participacao_pct) OVER (ORDER BY posicao ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS participacao_acumulada_pct
FROM (SELECT row_number() OVER (ORDER BY r DESC, id_vendedor) AS posicao, id_vendedor,
             CAST(r AS DOUBLE) AS receita_total, {_r('r', '(SELECT sum(receita_itens) FROM pedidos)')} AS participacao_pct
      FROM (SELECT s.id_vendedor, sum(s.valor_total_item) AS r FROM sales s JOIN vend v ON s.id_vendedor = v.id_vendedor
            GROUP BY s.id_vendedor {_top('sum(s.valor_total_item)', 's.id_vendedor', 10)}))""",
    "state_share": f"""
SELECT 'NATION_7' AS estado_cliente,
       CAST(sum(CASE WHEN estado_cliente = 'NATION_7' THEN receita_itens END) AS DOUBLE) AS receita_estado,
       CAST(sum(receita_itens) AS DOUBLE) AS receita_total,
       {_r("sum(CASE WHEN estado_cliente = 'NATION_7' THEN receita_itens END)", 'sum(receita_itens)')} AS participacao_pct
FROM pc""",
    "state_report": f"""
SELECT 'NATION_7' AS estado_cliente, CAST(CAST(sum(receita_itens) AS DECIMAL(15,2)) AS DOUBLE) AS receita_total,
       count(*) AS total_pedidos, round({_r('sum(receita_itens)', 'count(*)', '')}, 2) AS ticket_medio
FROM pc WHERE estado_cliente = 'NATION_7'""",
    "orders_by_weekday": """
SELECT CAST(isodow(data) AS BIGINT) AS dia_semana, dayname(data) AS nome_dia, count(*) AS total_pedidos,
       CAST(sum(receita_itens) AS DOUBLE) AS receita_total
FROM pedidos GROUP BY 1, 2""",
    "delivered_split": f"""
SELECT CAST(pedido_entregue AS BIGINT) AS valor, count(*) AS contagem,
       {_r('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM pedidos WHERE pedido_entregue IS NOT NULL GROUP BY pedido_entregue""",
    "late_split": f"""
SELECT CAST(entregue_com_atraso AS BIGINT) AS valor, count(*) AS contagem,
       {_r('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM pedidos WHERE pedido_entregue = 1 AND entregue_com_atraso IS NOT NULL GROUP BY entregue_com_atraso""",
    "data_period": """
SELECT CAST(min(data) AS VARCHAR) AS primeira_data, CAST(max(data) AS VARCHAR) AS ultima_data, count(*) AS total_pedidos
FROM pedidos""",
    "payload_root": """
SELECT CAST(min(data) AS VARCHAR) AS primeira_data, CAST(max(data) AS VARCHAR) AS ultima_data, count(*) AS total_pedidos
FROM pedidos""",
    "view_state_summary": f"""
SELECT estado_cliente, count(*) AS total_pedidos, CAST(sum(receita_itens) AS DOUBLE) AS receita_total,
       {_r('sum(receita_itens)', 'count(*)', '')} AS ticket_medio,
       {_r('sum(frete_itens)', 'sum(receita_itens)')} AS peso_frete_pct
FROM pc GROUP BY estado_cliente""",
    "view_month_summary": f"""
SELECT ano_mes, total_pedidos, CAST(r AS DOUBLE) AS receita_total, {_r('r', 'total_pedidos', '')} AS ticket_medio,
       {_r('r - lag(r) OVER (ORDER BY ano_mes)', 'lag(r) OVER (ORDER BY ano_mes)')} AS variacao_pct
FROM (SELECT ano_mes, count(*) AS total_pedidos, sum(receita_itens) AS r FROM pedidos GROUP BY ano_mes)""",
    "view_critical_orders": f"""
SELECT id_pedido, CAST(receita_itens AS DOUBLE) AS valor_pedido, CAST(frete_itens AS DOUBLE) AS frete_pedido,
       {_r('frete_itens', 'receita_itens')} AS peso_frete_pct,
       CASE WHEN pedido_critico = 1 THEN 'Sim' ELSE 'Não' END AS is_critico,
       {_r('frete_itens', 'receita_itens', '')} AS ordem_critico
FROM pedidos""",
    "critical_orders_list": f"""
SELECT id_pedido, CAST(receita_itens AS DOUBLE) AS valor_pedido, CAST(frete_itens AS DOUBLE) AS frete_pedido,
       {_r('frete_itens', 'receita_itens')} AS peso_frete_pct, 'Sim' AS is_critico,
       {_r('frete_itens', 'receita_itens', '')} AS ordem_critico
FROM pedidos WHERE pedido_critico = 1""",
    "view_delivery_performance": f"""
SELECT cli.estado_cliente, count(DISTINCT id_pedido) AS total_pedidos, {_of(ENTREGUE)} AS pedidos_entregues,
       {_of(ATRASADO)} AS pedidos_atrasados,
       round({_r('sum(tempo_entrega_dias)', 'count(tempo_entrega_dias)', '')}, 6) AS tempo_medio_entrega_dias,
       {_r(_of(ATRASADO), _of(ENTREGUE))} AS taxa_atraso_pct
FROM sales JOIN cli USING (id_cliente) GROUP BY cli.estado_cliente""",
    "kpi_snapshot": f"""
SELECT '2000-12-31' AS data_calculo, CAST(CAST(sum(receita_itens) AS DECIMAL(15,2)) AS DOUBLE) AS receita_total,
       count(*) AS total_pedidos, round({_r('sum(receita_itens)', 'count(*)', '')}, 2) AS ticket_medio,
       round({_r('count(*) FILTER (WHERE pedido_entregue = 1 AND entregue_com_atraso = 1)',
                 'count(*) FILTER (WHERE pedido_entregue = 1)')}, 2) AS taxa_atraso,
       round({_r('sum(pedido_critico)', 'count(*)')}, 2) AS perc_pedidos_criticos
FROM pedidos""",
    "month_summary": f"""
SELECT ano_mes, CAST(CAST(sum(receita_itens) AS DECIMAL(15,2)) AS DOUBLE) AS receita_total, count(*) AS total_pedidos,
       round({_r('sum(receita_itens)', 'count(*)', '')}, 2) AS ticket_medio
FROM pedidos GROUP BY ano_mes""",
    "formatted_kpis": f"""
SELECT {_brl('sum(receita_itens)')} AS receita_total, {_int('count(*)')} AS total_pedidos,
       {_brl(_r('sum(receita_itens)', 'count(*)', ''))} AS ticket_medio
FROM pedidos""",
    "formatted_views": f"""
SELECT ano_mes, {_brl('CAST(r AS DECIMAL(15,2))')} AS receita_total, {_int('n')} AS total_pedidos,
       {_brl(f"round({_r('r', 'n', '')}, 2)")} AS ticket_medio
FROM (SELECT ano_mes, sum(receita_itens) AS r, count(*) AS n FROM pedidos GROUP BY ano_mes)""",
    "cumulative_revenue": """
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal,
       CAST(sum(receita_mensal) OVER (ORDER BY ano_mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         AS receita_acumulada
FROM monthly""",
    "mom_variation": f"""
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal,
       round({_r('receita_mensal - lag(receita_mensal) OVER (ORDER BY ano_mes)',
                 'lag(receita_mensal) OVER (ORDER BY ano_mes)')}, 6) AS variacao_mom_pct
FROM monthly""",
    "mom_growth": """
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal, round(crescimento_mom_pct, 6) AS crescimento_mom_pct
FROM growth""",
    "falling_months": """
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal, round(crescimento_mom_pct, 6) AS crescimento_mom_pct
FROM growth WHERE crescimento_mom_pct < 0""",
    "mom_trimmed_mean": """
, v AS (SELECT crescimento_mom_pct AS x FROM growth WHERE crescimento_mom_pct IS NOT NULL),
st AS (SELECT count(*) AS n, quantile_cont(x, 0.05) AS p_inf, quantile_cont(x, 0.95) AS p_sup FROM v),
u AS (SELECT v.x FROM v, st WHERE st.n < 5 OR v.x BETWEEN st.p_inf AND st.p_sup)
SELECT st.n AS n_crescimentos, round(st.p_inf, 6) AS p_inf, round(st.p_sup, 6) AS p_sup,
       (SELECT count(*) FROM u) AS n_usados, round((SELECT avg(x) FROM u), 6) AS crescimento_medio_pct
FROM st""",
    "first_last_month": """
SELECT min(ano_mes) AS primeiro_mes, CAST(arg_min(receita_mensal, ano_mes) AS DOUBLE) AS valor_primeiro,
       max(ano_mes) AS ultimo_mes, CAST(arg_max(receita_mensal, ano_mes) AS DOUBLE) AS valor_ultimo
FROM monthly WHERE receita_mensal > 0""",
    "month_spine": "SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_mensal FROM rev_spine",
    "rate_monthly": "SELECT ano_mes, round(cotacao, 6) AS cotacao FROM rates",
    "rate_filled": "SELECT ano_mes, round(cotacao, 6) AS cotacao FROM rates_filled",
    "series_correlation": """
SELECT count(*) AS n_meses,
       round(CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END, 6) AS correlacao
FROM (SELECT CAST(r.receita_mensal AS DOUBLE) AS a, CAST(f.cotacao AS DOUBLE) AS b
      FROM rev_spine r JOIN rates_filled f USING (ano_mes)
      WHERE r.receita_mensal IS NOT NULL AND f.cotacao IS NOT NULL)""",
    "series_verdict": """
SELECT n_meses, correlacao,
       CASE WHEN correlacao > 0.5 THEN 'positiva_forte' WHEN correlacao < -0.5 THEN 'negativa_forte'
            WHEN correlacao IS NOT NULL THEN 'fraca' END AS veredito
FROM (SELECT count(*) AS n_meses,
       round(CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END, 6) AS correlacao
      FROM (SELECT CAST(r.receita_mensal AS DOUBLE) AS a, CAST(f.cotacao AS DOUBLE) AS b
            FROM rev_spine r JOIN rates_filled f USING (ano_mes)
            WHERE r.receita_mensal IS NOT NULL AND f.cotacao IS NOT NULL))""",
    "rate_change": f"""
SELECT min(ano_mes) AS primeiro_mes, round(arg_min(cotacao, ano_mes), 6) AS valor_primeiro,
       max(ano_mes) AS ultimo_mes, round(arg_max(cotacao, ano_mes), 6) AS valor_ultimo,
       round({_r('arg_max(cotacao, ano_mes) - arg_min(cotacao, ano_mes)', 'arg_min(cotacao, ano_mes)')}, 6) AS variacao_pct
FROM rates_filled""",
    "month_trend": """
SELECT n.ano_mes, n.mes_num, CAST(n.receita_mensal AS DOUBLE) AS valor,
       round(f.intercepto + f.inclinacao * CAST(n.mes_num AS DOUBLE), 2) AS previsao
FROM numbered n, fit f""",
    "forecast": """
SELECT f.ultimo_mes_num + h AS mes_num,
       strftime(CAST(ultimo_ano_mes || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS ano_mes,
       round(f.intercepto + f.inclinacao * CAST(f.ultimo_mes_num + h AS DOUBLE), 2) AS previsao
FROM fit f, range(1, 4) t(h)""",
    "trend_quality": """
SELECT f.n_meses, round(f.inclinacao, 4) AS inclinacao, round(f.intercepto, 2) AS intercepto, round(f.r2, 8) AS r2,
       round(avg(abs(CAST(n.receita_mensal AS DOUBLE) - (f.intercepto + f.inclinacao * CAST(n.mes_num AS DOUBLE)))), 2)
         AS mae,
       CASE WHEN f.r2 > 0.7 THEN 'explica_bem' WHEN f.r2 IS NOT NULL THEN 'alta_variabilidade' END AS veredito
FROM numbered n, fit f GROUP BY f.n_meses, f.inclinacao, f.intercepto, f.r2""",
    "ticket_histogram": """
, x AS (SELECT CAST(valor_pedido AS DOUBLE) AS x FROM pedidos WHERE valor_pedido IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
cnt AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((x - lo) / (hi - lo) * 50.0) + 1, 50) END AS BIGINT)
          AS bin, count(*) AS contagem FROM x, rng GROUP BY 1),
grid AS (SELECT CAST(b AS BIGINT) AS bin, round(lo + (hi - lo) * (b - 1) / 50.0, 6) AS inicio,
                round(lo + (hi - lo) * b / 50.0, 6) AS fim
         FROM rng CROSS JOIN range(1, 51) t(b) WHERE b <= CASE WHEN hi - lo = 0 THEN 1 ELSE 50 END)
SELECT grid.bin, inicio, fim, coalesce(contagem, 0) AS contagem FROM grid LEFT JOIN cnt USING (bin)""",
    "delivery_histogram": """
, x AS (SELECT CAST(tempo_medio_entrega_dias AS DOUBLE) AS x FROM pedidos
        WHERE pedido_entregue = 1 AND tempo_medio_entrega_dias IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
cnt AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((x - lo) / (hi - lo) * 40.0) + 1, 40) END AS BIGINT)
          AS bin, count(*) AS contagem FROM x, rng GROUP BY 1),
grid AS (SELECT CAST(b AS BIGINT) AS bin, round(lo + (hi - lo) * (b - 1) / 40.0, 6) AS inicio,
                round(lo + (hi - lo) * b / 40.0, 6) AS fim
         FROM rng CROSS JOIN range(1, 41) t(b) WHERE b <= CASE WHEN hi - lo = 0 THEN 1 ELSE 40 END)
SELECT grid.bin, inicio, fim, coalesce(contagem, 0) AS contagem FROM grid LEFT JOIN cnt USING (bin)""",
    "ticket_density": """
, x AS (SELECT CAST(valor_pedido AS DOUBLE) AS x FROM pedidos WHERE valor_pedido IS NOT NULL),
vals AS (SELECT x, count(*) AS c FROM x GROUP BY x),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n,
              stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM x),
pts AS (SELECT CAST(i AS BIGINT) AS ponto, lo + (hi - lo) / 199.0 * CAST(i AS DOUBLE) AS g FROM st, range(0, 200) t(i)),
s AS (SELECT ponto, g, sum(c * exp(-0.5 * (((g - x) / h) * ((g - x) / h)))) AS s FROM pts, vals, st WHERE h > 0 GROUP BY ponto, g)
SELECT ponto, round(g, 6) AS x, round(s / (CAST(n AS DOUBLE) * h * sqrt(2 * pi())) * 1e6, 6) AS densidade_x1e6
FROM s, st""",
    "payload_states": f"""
SELECT row_number() OVER (ORDER BY r DESC NULLS LAST, estado_cliente) AS posicao, estado_cliente,
       CAST(r AS DOUBLE) AS receita_total, {_brl('r')} AS receita_texto
FROM (SELECT estado_cliente, sum(receita_itens) AS r FROM pc WHERE estado_cliente IS NOT NULL GROUP BY estado_cliente)""",
    "payload_months": f"""
SELECT ano_mes, CAST(receita_mensal AS DOUBLE) AS receita_total, {_brl('receita_mensal')} AS receita_texto FROM monthly""",
    "payload_insights": f"""
SELECT CAST(sum(pedido_critico) AS BIGINT) AS pedidos_criticos, count(*) AS total_pedidos,
       round({_r('sum(pedido_critico)', 'count(*)')}, 6) AS pct_criticos,
       {_pct(_r('sum(pedido_critico)', 'count(*)'))} AS pct_criticos_texto,
       round({_r('count(*) FILTER (WHERE pedido_entregue = 1 AND entregue_com_atraso = 1)',
                 'count(*) FILTER (WHERE pedido_entregue = 1)')}, 6) AS taxa_atraso_pct,
       {_pct(_r('count(*) FILTER (WHERE pedido_entregue = 1 AND entregue_com_atraso = 1)',
                'count(*) FILTER (WHERE pedido_entregue = 1)'))} AS taxa_atraso_texto
FROM pedidos""",
    "payload_freight": f"""
SELECT row_number() OVER (ORDER BY frete_pct DESC NULLS LAST, estado_cliente) AS posicao, estado_cliente,
       round(frete_pct, 6) AS frete_pct, {_pct('frete_pct')} AS frete_texto, total_pedidos,
       {_int('total_pedidos')} AS pedidos_texto
FROM (SELECT estado_cliente, {_r('sum(frete_itens)', 'sum(receita_itens)')} AS frete_pct, count(*) AS total_pedidos
      FROM pc WHERE estado_cliente IS NOT NULL GROUP BY estado_cliente {_top('frete_pct', 'estado_cliente', 5)})""",
    "payload_late": f"""
SELECT row_number() OVER (ORDER BY taxa DESC NULLS LAST, estado_cliente) AS posicao, estado_cliente,
       round(taxa, 6) AS taxa_atraso_pct, {_pct('taxa')} AS taxa_texto, total_pedidos,
       {_int('total_pedidos')} AS pedidos_texto
FROM (SELECT estado_cliente, count(*) AS total_pedidos,
             {_r('count(*) FILTER (WHERE entregue_com_atraso = 1)', 'count(*) FILTER (WHERE pedido_entregue = 1)')} AS taxa
      FROM pc WHERE estado_cliente IS NOT NULL GROUP BY estado_cliente HAVING count(*) >= 450
      {_top('taxa', 'estado_cliente', 5)})""",
    "change_log": f"""
SELECT operacao, tabela_afetada, chave, dados_anteriores, dados_novos, {_ts('data_consulta')} AS data_consulta FROM clog""",
    "change_log_view": f"""
SELECT operacao, tabela_afetada, chave, {_ts('data_consulta')} AS data_consulta,
       substring(coalesce(dados_novos, dados_anteriores), 1, 200) AS resumo FROM clog""",
    "log_retention": f"""
SELECT operacao, tabela_afetada, chave, dados_anteriores, dados_novos, {_ts('data_consulta')} AS data_consulta
FROM clog WHERE data_consulta >= CAST(DATE '2000-12-31' - INTERVAL 90 DAY AS TIMESTAMP)""",
    "apply_changes": "SELECT id_cliente, n_pedidos, primeiro_pedido, ultimo_pedido FROM act_new",
}


def _json_map(key: str, value: str, order: str) -> str:
    """One row: the JSON object of ``key`` -> ``value`` (JSON text) in ``order``."""
    return f"""'{{' || coalesce(string_agg('"' || {key} || '":' || {value}, ',' ORDER BY {order}), '') || '}}'"""


WIDE_SPINE = """
, wide AS (SELECT strftime(m, '%Y-%m') AS ano_mes
  FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2002-12-01', INTERVAL 1 MONTH) t(m))"""
TEXT_ROWS = """
, txt AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END AS instante,
    CASE WHEN event_type = 'error' THEN event_type ELSE regexp_extract(props, ': ([0-9]+)', 1) END AS valor FROM events)"""

BODIES |= {
    "city_respelled": f"""
SELECT CASE WHEN cidade_cliente IN ('automobile nation_7', 'building nation_7', 'furniture nation_7', 'household nation_7',
         'machinery nation_7') THEN 'Nation 7' ELSE cidade_cliente END AS cidade_normalizada,
       count(DISTINCT id_pedido) AS total_pedidos
FROM sales WHERE id_cliente IS NOT NULL GROUP BY 1 {_top('count(DISTINCT id_pedido)', '1')}""",
    "enriched_base": """
SELECT f.id_pedido AS order_id, CAST(f.id_item_pedido AS BIGINT) AS order_item_id, f.id_produto AS product_id,
       f.id_vendedor AS seller_id, p.p_type AS product_category_name, CAST(p.p_size AS BIGINT) AS product_weight_g,
       lower(n.n_name) AS seller_city, n.n_name AS seller_state, CAST(f.valor_total_item AS DOUBLE) AS valor_total_item
FROM fato f LEFT JOIN part p ON f.id_produto = p.p_partkey LEFT JOIN supplier s ON f.id_vendedor = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "dim_clientes_earliest": """
SELECT estado_cliente AS id_cliente, cep_prefixo_cliente, cidade_cliente, estado_cliente
FROM (SELECT c.*, row_number() OVER (PARTITION BY c.estado_cliente ORDER BY o.ts_compra, o.order_id) AS nr
      FROM o JOIN c ON o.customer_id = c.customer_id WHERE c.estado_cliente IS NOT NULL)
WHERE nr = 1""",
    "text_cleaned": TEXT_ROWS + f"""
SELECT event_id, {_ts('TRY_CAST(instante AS TIMESTAMP)')} AS instante, TRY_CAST(valor AS DOUBLE) AS valor,
       coalesce(TRY_CAST(valor AS DOUBLE), 0) AS valor_ou_zero FROM txt""",
    "text_keyed": TEXT_ROWS + f"""
SELECT event_id, {_ts('TRY_CAST(instante AS TIMESTAMP)')} AS instante, coalesce(TRY_CAST(valor AS DOUBLE), 0) AS valor,
       coalesce(TRY_CAST(valor AS DOUBLE), 0) AS valor_ou_zero FROM txt WHERE TRY_CAST(instante AS TIMESTAMP) IS NOT NULL""",
    "formatted_snapshot": f"""
SELECT '2000-12-31' AS data_calculo, {_brl('CAST(sum(receita_itens) AS DECIMAL(15,2))')} AS receita_total,
       {_int('count(*)')} AS total_pedidos, {_brl(f"round({_r('sum(receita_itens)', 'count(*)', '')}, 2)")} AS ticket_medio,
       {_pct(f"round({_r('count(*) FILTER (WHERE pedido_entregue = 1 AND entregue_com_atraso = 1)', 'count(*) FILTER (WHERE pedido_entregue = 1)')}, 2)")} AS taxa_atraso,
       {_pct(f"round({_r('sum(pedido_critico)', 'count(*)')}, 2)")} AS perc_pedidos_criticos
FROM pedidos""",
    "formatted_delivery": f"""
SELECT estado_cliente, {_int('n')} AS total_pedidos, {_int('e')} AS pedidos_entregues, {_int('a')} AS pedidos_atrasados,
       CAST(CAST(round(CAST(d AS DECIMAL(38,10)), 0) AS BIGINT) AS VARCHAR) || ' dias' AS tempo_medio_entrega,
       {_pct(_r('a', 'e'))} AS taxa_atraso_pct
FROM (SELECT cli.estado_cliente, count(DISTINCT id_pedido) AS n,
             count(DISTINCT CASE WHEN pedido_entregue = 1 THEN id_pedido END) AS e,
             count(DISTINCT CASE WHEN entregue_com_atraso = 1 THEN id_pedido END) AS a,
             round({_r('sum(tempo_entrega_dias)', 'count(tempo_entrega_dias)', '')}, 6) AS d
      FROM sales JOIN cli USING (id_cliente) GROUP BY cli.estado_cliente)""",
    "month_spine_wide": WIDE_SPINE + """
SELECT w.ano_mes, coalesce(CAST(m.receita_mensal AS DOUBLE), 0) AS receita_mensal FROM wide w LEFT JOIN monthly m USING (ano_mes)""",
    "rate_filled_wide": WIDE_SPINE + """
SELECT w.ano_mes, round(CASE WHEN w.ano_mes < (SELECT min(ano_mes) FROM rates) THEN (SELECT arg_min(cotacao, ano_mes) FROM rates)
  ELSE (SELECT arg_max(r.cotacao, r.ano_mes) FROM rates r WHERE r.ano_mes <= w.ano_mes) END, 6) AS cotacao FROM wide w""",
    "payload_states_map": f"""
SELECT {_json_map('estado_cliente', f"""'"' || {_brl('r')} || '"'""", 'r DESC NULLS LAST, estado_cliente')} AS receita_por_estado,
       {_pct(_r("sum(r) FILTER (WHERE estado_cliente = 'NATION_7')", '(SELECT sum(receita_itens) FROM pc)'))} AS participacao_foco
FROM (SELECT estado_cliente, sum(receita_itens) AS r FROM pc WHERE estado_cliente IS NOT NULL GROUP BY estado_cliente)""",
    "payload_months_map": f"""
SELECT {_json_map('ano_mes', f"""'"' || {_brl('receita_mensal')} || '"'""", 'ano_mes')} AS receita_mensal FROM monthly""",
    "payload_freight_map": f"""
SELECT {_json_map('estado_cliente', f"""'{{"frete_percentual":"' || {_pct('p')} || '","total_pedidos":"' || {_int('n')} || '"}}'""", 'p DESC NULLS LAST, estado_cliente')}
  AS estados_maior_frete
FROM (SELECT cli.estado_cliente, {_r('sum(valor_frete)', 'sum(valor_total_item)')} AS p, count(DISTINCT id_pedido) AS n
      FROM sales JOIN cli USING (id_cliente) WHERE cli.estado_cliente IS NOT NULL GROUP BY cli.estado_cliente
      {_top('p', 'cli.estado_cliente', 5)})""",
    "payload_late_map": f"""
SELECT {_json_map('estado_cliente', f"""'{{"taxa_atraso":"' || {_pct('p')} || '","total_pedidos":"' || {_int('n')} || '"}}'""", 'p DESC NULLS LAST, estado_cliente')}
  AS estados_maior_atraso
FROM (SELECT cli.estado_cliente, count(DISTINCT id_pedido) AS n,
             {_r('count(DISTINCT CASE WHEN entregue_com_atraso = 1 THEN id_pedido END)',
                 'count(DISTINCT CASE WHEN pedido_entregue = 1 THEN id_pedido END)')} AS p
      FROM sales JOIN cli USING (id_cliente) WHERE cli.estado_cliente IS NOT NULL GROUP BY cli.estado_cliente
      HAVING count(DISTINCT id_pedido) >= 450 {_top('p', 'cli.estado_cliente', 5)})""",
}


def oracle() -> dict[str, str]:
    out = {}
    for k, body in BODIES.items():
        b = body.strip("\n")
        # bodies that start with ", name AS (...)" extend the CTE list before their SELECT
        out[k] = PREFIX + ("\n" if b.startswith(",") else "\n") + b
    return out


FACT_COLUMNS = ["id_pedido", "id_item_pedido", "id_produto", "id_vendedor", "id_cliente", "data", "status_pedido",
                "valor_produto", "valor_frete", "valor_total_item", "tempo_entrega_dias", "prazo_estimado_dias",
                "atraso_entrega_dias", "entregue_com_atraso", "pedido_entregue"]


def _nulls_union() -> str:
    parts = [f"SELECT '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) AS nulos, count(*) AS n FROM fato"
             for c in FACT_COLUMNS]
    return "\nUNION ALL ".join(parts)


BODIES["profile_nulls"] = f"""
SELECT coluna, nulos, round({_r('nulos', 'n')}, 2) AS pct_nulos FROM ({_nulls_union()})"""
BODIES["profile_top_nulls"] = f"""
SELECT coluna, nulos, round({_r('nulos', 'n')}, 2) AS pct_nulos FROM ({_nulls_union()})
ORDER BY nulos DESC, coluna ASC LIMIT 15"""
