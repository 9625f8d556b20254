"""Query registry: key -> Spark job over the driver tables.

Each job reads the parquet tables of ``sf_dir`` through the adapter, builds
the mart lazily and returns a DataFrame; nothing runs until the caller acts.
``finish`` fixes the result types for comparison with the DuckDB oracle:
decimals -> double (exact sums, correctly rounded), small ints -> bigint,
dates/timestamps -> ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.functions.columns import city_normal, item_total, safe_double, safe_double_or_zero, safe_timestamp, share_pct
from salesmart.functions.text import YES, brl, int_text
from salesmart.operators import changelog as G
from salesmart.operators import cleaning as C
from salesmart.operators import distribution as D
from salesmart.operators import forecast as M
from salesmart.operators import payloads as P
from salesmart.operators import quality as Q
from salesmart.operators import reports as R
from salesmart.operators import series as S
from salesmart.operators import mart as mart_ops
from salesmart.operators.mart import Mart, sales_base
from salesmart.operators.orders import order_facts_direct, with_customer
from salesmart.params import Params, Period, driver_params
from salesmart.sources.tpch import driver_base, driver_orders, raw_tables, raw_text, table


# Parameters that make spine, fills and city map act on the driver tables: a spine wider than the
# report period, and one common spelling for the cities of the focus state.
WIDE_PERIOD = Period.of("1994-01-01", "2002-12-31")
CITY_SPELLINGS = {f"{s} nation_7": "Nation 7" for s in ("automobile", "building", "furniture", "household", "machinery")}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.TimestampNTZType):
            c = c.cast("string")  # wall clock as stored; date_format would pass through the session zone
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Job:
    """Lazily built inputs shared by the reports of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.p = params or driver_params()

    @cached_property
    def raw(self):
        return raw_tables(self.spark, self.sf_dir)

    @cached_property
    def base(self) -> DataFrame:
        return driver_base(self.raw, self.p)

    @cached_property
    def customer_base(self) -> DataFrame:
        """Item rows with the customer's city and state, joined at order grain."""
        return driver_base(self.raw, self.p, self.raw.customers.select("customer_id", "customer_city", "customer_state"))

    @cached_property
    def order_base(self) -> DataFrame:
        return driver_orders(self.raw, self.p)

    @cached_property
    def sold_items(self) -> DataFrame:
        """Product and seller of the items whose order exists."""
        return self.raw.items.select("order_id", "product_id", "seller_id").join(self.raw.orders.select("order_id"), "order_id", "left_semi")

    @cached_property
    def items(self) -> DataFrame:
        """Item rows under the fact's names, of orders that exist; the items are read once."""
        i = self.raw.items.withColumn("valor_total_item", item_total("price", "freight_value")).join(self.raw.orders.select("order_id"), "order_id", "left_semi")
        return self._named_items(i)

    @cached_property
    def period_items(self) -> DataFrame:
        """Item rows of the period's orders: a plain join on the order, so AQE can split a hot one."""
        per = self.p.period
        o = self.raw.orders.where(F.to_date("order_purchase_timestamp").between(F.lit(per.start), F.lit(per.end))).select("order_id")
        i = self.raw.items.withColumn("valor_total_item", item_total("price", "freight_value"))
        return self._named_items(i.join(o, "order_id"))

    @staticmethod
    def _named_items(i: DataFrame) -> DataFrame:
        return i.select(F.col("order_id").alias("id_pedido"), F.col("order_item_id").alias("id_item_pedido"), F.col("product_id").alias("id_produto"),
                        F.col("seller_id").alias("id_vendedor"), F.col("price").alias("valor_produto"), F.col("freight_value").alias("valor_frete"), "valor_total_item")

    @cached_property
    def customers(self) -> DataFrame:
        # both sides of the joins with it are plain exchanges, so AQE can split a hot customer
        return mart_ops.customers_as_dim(self.raw.customers)

    @cached_property
    def fato(self) -> DataFrame:
        return mart_ops.fato_vendas(self.base)

    @cached_property
    def dim_clientes(self) -> DataFrame:
        # in this adapter the unique customer id is the customer key (see sources.tpch)
        return mart_ops.dim_clientes_by_key(self.raw.customers, self.raw.orders)

    @cached_property
    def dim_produtos(self) -> DataFrame:
        return mart_ops.dim_produtos(self.sold_items, self.raw.products)

    @cached_property
    def dim_vendedores(self) -> DataFrame:
        return mart_ops.dim_vendedores(self.sold_items, self.raw.sellers)

    @cached_property
    def dim_tempo(self) -> DataFrame:
        return mart_ops.dim_tempo(self.raw.orders)

    @property
    def mart(self) -> Mart:
        return Mart(self.fato, self.dim_clientes, self.dim_produtos, self.dim_vendedores, self.dim_tempo)

    @cached_property
    def sales(self) -> DataFrame:
        return self.fato.where(F.col("data").between(F.lit(self.p.period.start), F.lit(self.p.period.end)))

    @cached_property
    def orders(self) -> DataFrame:
        per = self.p.period
        o = self.order_base.where(F.to_date("order_purchase_timestamp").between(F.lit(per.start), F.lit(per.end)))
        return order_facts_direct(o, self.p.thresholds)

    @cached_property
    def orders_c(self) -> DataFrame:
        return with_customer(self.orders, self.customers)

    @cached_property
    def monthly(self) -> DataFrame:
        return S.monthly(self.orders)

    @cached_property
    def growth(self) -> DataFrame:
        return S.growth(self.monthly)

    @cached_property
    def revenue_on_spine(self) -> DataFrame:
        spine = S.month_spine(self.spark, self.p.period)
        return S.on_spine(spine, self.monthly, ["receita_mensal"])

    @cached_property
    def rates(self) -> DataFrame:
        """External monthly series stand-in: mean line quantity by ship month."""
        li = table(self.spark, self.sf_dir, "lineitem")
        per = self.p.period
        li = li.where(F.to_date("l_shipdate").between(F.lit(per.start), F.lit(per.end)))
        return S.monthly_mean(li, "l_shipdate", "l_quantity", "cotacao")

    @cached_property
    def rates_filled(self) -> DataFrame:
        spine = S.month_spine(self.spark, self.p.period)
        return S.fill_both(S.on_spine(spine, self.rates), "cotacao")

    @cached_property
    def numbered(self) -> DataFrame:
        return M.number_months(self.monthly)

    @cached_property
    def fit(self) -> DataFrame:
        return M.trend(self.numbered, "receita_mensal")

    def customer_activity(self, window: Period) -> DataFrame:
        """Snapshot of customers active in a window: orders, first and last order date."""
        o = self.raw.orders.select(F.col("customer_id").alias("id_cliente"), F.to_date("order_purchase_timestamp").alias("data"))
        o = o.where(F.col("data").between(F.lit(window.start), F.lit(window.end)))
        return (o.where(F.col("id_cliente").isNotNull()).groupBy("id_cliente")
                .agg(F.count("*").alias("n_pedidos"),
                     F.date_format(F.min("data"), "yyyy-MM-dd").alias("primeiro_pedido"),
                     F.date_format(F.max("data"), "yyyy-MM-dd").alias("ultimo_pedido")))

    @cached_property
    def activity_old(self) -> DataFrame:
        return self.customer_activity(self.p.log_old)

    @cached_property
    def activity_new(self) -> DataFrame:
        return self.customer_activity(self.p.log_new)

    @cached_property
    def change_log(self) -> DataFrame:
        at = F.to_timestamp_ntz(F.coalesce(F.col("_new.ultimo_pedido"), F.col("_old.ultimo_pedido")))
        return G.change_log(self.activity_old, self.activity_new, "id_cliente", "clientes_ativos", at)


def _q(fn: Callable[[Job], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(fn(Job(spark, sf_dir)))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _kpi_totals(j: Job):
    return R.kpi_totals(j.orders)


def _order_facts(j: Job):
    return j.orders.select("id_pedido", "id_cliente", "data", "status_pedido", "valor_pedido", "frete_pedido",
                           "n_itens", "entregue_com_atraso", "pedido_entregue",
                           F.round("tempo_medio_entrega_dias", 6).alias("tempo_medio_entrega_dias"),
                           F.round("peso_frete_pedido_pct", 6).alias("peso_frete_pedido_pct"), "pedido_critico")


def _delivery_days(j: Job):
    return j.order_base.select(F.col("order_id").alias("id_pedido"), "tempo_entrega_dias", "prazo_estimado_dias",
                               "atraso_entrega_dias")


def _late_flag(j: Job):
    return j.order_base.select(F.col("order_id").alias("id_pedido"), F.col("order_status").alias("status_pedido"),
                               "entregue_com_atraso", "pedido_entregue")


def _item_value(j: Job):
    return j.items.where(F.col("id_item_pedido").isNotNull()).select(
        "id_pedido", "id_item_pedido", "valor_produto", "valor_frete", "valor_total_item")


def _item_freight_pct(j: Job):
    return j.items.where(F.col("id_item_pedido").isNotNull()).select(
        "id_pedido", "id_item_pedido",
        F.round(share_pct("valor_frete", "valor_produto"), 6).alias("peso_frete_pct"))


def _time_parts(j: Job):
    return j.dim_tempo


def _analytic_base(j: Job):
    return j.customer_base.select("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                    "order_delivered_customer_date", "order_estimated_delivery_date", "customer_city",
                    "customer_state", "order_item_id", "product_id", "seller_id", "price", "freight_value",
                    "valor_total_item", "ano_mes", "tempo_entrega_dias", "prazo_estimado_dias",
                    "atraso_entrega_dias", "entregue_com_atraso", "pedido_entregue")


def _sales_base(j: Job):
    # attributes are added to given rows, so the whole raw dimensions serve: no pass over the items for their keys
    m = Mart(j.fato, j.customers, mart_ops.products_as_dim(j.raw.products), mart_ops.sellers_as_dim(j.raw.sellers), j.dim_tempo)
    sb = sales_base(m, j.p.period)
    return sb.select("id_pedido", "id_item_pedido", "id_cliente", "id_produto", "id_vendedor", "data", "ano_mes",
                     "status_pedido", "valor_total_item", "valor_frete", "estado_cliente", "cidade_cliente",
                     "categoria_produto", "estado_vendedor")


def _api_base(j: Job):
    """Fact with customer state, NULL states dropped, money NULL -> 0."""
    per = j.p.period
    b = j.customer_base.withColumn("data", F.to_date("order_purchase_timestamp"))
    b = b.where(F.col("data").between(F.lit(per.start), F.lit(per.end)) & F.col("customer_state").isNotNull())
    return b.select(
        F.col("order_id").alias("id_pedido"), F.col("order_item_id").alias("id_item_pedido"), "data",
        F.col("customer_state").alias("estado_cliente"),
        F.coalesce("valor_total_item", F.lit(0).cast("decimal(38,4)")).alias("valor_total_item"),
        F.coalesce("freight_value", F.lit(0).cast("decimal(38,4)")).alias("valor_frete"))


def _orders_dedup(j: Job):
    """One row per order with the first of its items in column order; the items are reduced per order before the join,
    so they're read once and a hot order is one row per task (A24)."""
    item = F.struct("order_item_id", "product_id", "seller_id", "price", "freight_value")
    first = j.raw.items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.min(item).alias("r"))
    o = j.raw.orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp").distinct()
    return o.join(first, "order_id", "left").select("order_id", "customer_id", "order_status", "order_purchase_timestamp", "r.*")


def _dim(name):
    def f(j: Job):
        return getattr(j, name)
    f.__name__ = name
    return f


def _table_counts(j: Job):
    m = j.mart
    return Q.table_counts({"dim_clientes": m.dim_clientes, "dim_produtos": m.dim_produtos,
                           "dim_vendedores": m.dim_vendedores, "dim_tempo": m.dim_tempo, "fato_vendas": m.fato})


def _profile_shape(j: Job):
    m = j.mart
    parts = [Q.profile_shape(df, n) for n, df in
             [("fato_vendas", m.fato), ("dim_clientes", m.dim_clientes), ("dim_produtos", m.dim_produtos),
              ("dim_vendedores", m.dim_vendedores), ("dim_tempo", m.dim_tempo)]]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _profile_nulls(j: Job):
    return Q.profile_nulls(j.fato).drop("tipo")


def _profile_top_nulls(j: Job):
    return Q.top_nulls(j.fato, 15).drop("tipo")


def _profile_duplicates(j: Job):
    return Q.duplicate_rows(j.fato)


def _critical_orders(j: Job):
    return R.critical_orders(j.orders)


def _monthly_revenue(j: Job):
    return j.monthly


def _late_rate(j: Job):
    return R.late_rate(j.orders)


def _late_rate_known(j: Job):
    return R.late_rate_known(j.orders)


def _kpi_delivery(j: Job):
    return R.kpi_delivery(j.orders)


def _kpi_freight(j: Job):
    return R.kpi_freight(j.orders)


def _executive_dashboard(j: Job):
    return R.executive_dashboard(j.orders)


def _revenue_by_state(j: Job):
    return R.revenue_by(j.orders_c, "estado_cliente", j.p.top_k)


def _orders_by_city(j: Job):
    return R.orders_by(j.orders_c, "cidade_cliente", j.p.top_k)


def _city_normalized(j: Job):
    oc = j.orders_c.withColumn("cidade_normalizada", city_normal("cidade_cliente"))
    return R.orders_by(oc, "cidade_normalizada", j.p.top_k)


def _city_respelled(j: Job):
    oc = j.orders_c.withColumn("cidade_normalizada", city_normal("cidade_cliente", CITY_SPELLINGS))
    return R.orders_by(oc, "cidade_normalizada", j.p.top_k)


def _enriched_base(j: Job):
    """Item rows with product and seller attributes."""
    return C.enrich(j.base, j.raw.products, j.raw.sellers).select(
        "order_id", "order_item_id", "product_id", "seller_id", "product_category_name", "product_weight_g",
        "seller_city", "seller_state", "valor_total_item")


def _dim_clientes_earliest(j: Job):
    """Customer dimension where many customers share a unique id, here their state: the city of the earliest purchase."""
    customers = j.raw.customers.withColumn("customer_unique_id", F.col("customer_state"))
    return mart_ops.dim_clientes(j.raw.orders.join(customers, "customer_id", "left"))


def _text_cleaned(j: Job):
    """Text to time and numbers; what can't be parsed is NULL, or 0."""
    return raw_text(j.raw).select("event_id", safe_timestamp("instante").alias("instante"), safe_double("valor").alias("valor"),
                                  safe_double_or_zero("valor").alias("valor_ou_zero"))


def _text_keyed(j: Job):
    """Cleaned rows with a time, missing numbers 0."""
    return C.fill_zero(C.drop_null_keys(_text_cleaned(j), ["instante"]), ["valor"])


def _revenue_by_city(j: Job):
    return R.revenue_by(j.orders_c, "cidade_cliente", j.p.top_k)


def _revenue_by_seller(j: Job):
    return R.revenue_by_seller(j.period_items, None, j.p.top_k)


def _revenue_by_category(j: Job):
    return R.revenue_by_category(j.period_items, mart_ops.products_as_dim(j.raw.products), j.p.top_k, "left")


def _items_by_category(j: Job):
    return R.items_by_category(j.period_items, mart_ops.products_as_dim(j.raw.products), j.p.top_k, "left")


def _ticket_by_state(j: Job):
    return R.ticket_by(j.orders_c, "estado_cliente")


def _freight_share_by_state(j: Job):
    return R.freight_share_by(j.orders_c, "estado_cliente")


def _late_rate_by_state(j: Job):
    return R.late_rate_by(j.orders_c, "estado_cliente", j.p.min_orders)


def _delivery_time_by_state(j: Job):
    return R.delivery_time_by(j.orders_c, "estado_cliente", "item")


def _delivery_time_by_state_orders(j: Job):
    return R.delivery_time_by(j.orders_c, "estado_cliente", "order")


def _revenue_by_status(j: Job):
    return R.revenue_by_status(j.orders)


def _concentration_states(j: Job):
    total = j.orders.agg(F.sum("receita_itens").alias("total"))
    return R.concentration(R.revenue_by(j.orders_c, "estado_cliente"), "estado_cliente", "receita_total", total, 5)


def _concentration_sellers(j: Job):
    total = j.orders.agg(F.sum("receita_itens").alias("total"))
    return R.concentration(R.revenue_by_seller(j.period_items, None, None),
                           "id_vendedor", "receita_total", total, 10)


def _state_share(j: Job):
    return R.state_share(j.orders_c, j.p.focus_state)


def _state_report(j: Job):
    return R.state_report(j.orders_c, j.p.focus_state)


def _orders_by_weekday(j: Job):
    return R.orders_by_weekday(j.orders)


def _delivered_split(j: Job):
    return R.value_split(j.orders, "pedido_entregue")


def _late_split(j: Job):
    return R.value_split(j.orders.where(F.col("pedido_entregue") == 1), "entregue_com_atraso")


def _data_period(j: Job):
    return R.data_period(j.orders)


def _view_state_summary(j: Job):
    return R.view_state_summary(j.orders_c)


def _view_month_summary(j: Job):
    return R.view_month_summary(j.orders)


def _view_critical_orders(j: Job):
    return R.view_critical_orders(j.orders)


def _critical_orders_list(j: Job):
    return R.view_critical_orders(j.orders).where(F.col("is_critico") == YES)


def _view_delivery_performance(j: Job):
    return R.view_delivery_performance(j.orders_c)


def _kpi_snapshot(j: Job):
    return R.kpi_snapshot(j.orders, j.p.period.end)


def _month_summary(j: Job):
    return R.month_summary(j.orders)


def _formatted_kpis(j: Job):
    return P.formatted_kpis(j.orders)


def _formatted_views(j: Job):
    m = R.month_summary(j.orders)
    return m.select("ano_mes", brl("receita_total").alias("receita_total"),
                    int_text("total_pedidos").alias("total_pedidos"), brl("ticket_medio").alias("ticket_medio"))


def _formatted_snapshot(j: Job):
    return P.formatted_snapshot(R.kpi_snapshot(j.orders, j.p.period.end))


def _formatted_delivery(j: Job):
    return P.formatted_delivery(R.view_delivery_performance(j.orders_c))


def _cumulative_revenue(j: Job):
    return S.cumulative(j.monthly)


def _mom_variation(j: Job):
    return S.mom_variation(j.monthly).withColumn("variacao_mom_pct", F.round("variacao_mom_pct", 6))


def _mom_growth(j: Job):
    return j.growth.withColumn("crescimento_mom_pct", F.round("crescimento_mom_pct", 6))


def _falling_months(j: Job):
    return S.falling_months(j.growth).withColumn("crescimento_mom_pct", F.round("crescimento_mom_pct", 6))


def _mom_trimmed_mean(j: Job):
    return S.trimmed_mean(j.growth)


def _first_last_month(j: Job):
    return S.first_last(j.monthly.where(F.col("receita_mensal") > 0), "receita_mensal")


def _month_spine(j: Job):
    return j.revenue_on_spine


def _rate_monthly(j: Job):
    return j.rates.withColumn("cotacao", F.round("cotacao", 6))


def _rate_filled(j: Job):
    return j.rates_filled.withColumn("cotacao", F.round("cotacao", 6))


def _month_spine_wide(j: Job):
    return S.on_spine(S.month_spine(j.spark, WIDE_PERIOD), j.monthly, ["receita_mensal"])


def _rate_filled_wide(j: Job):
    """Months before the first rate and after the last one take their neighbour's."""
    wide = S.on_spine(S.month_spine(j.spark, WIDE_PERIOD), j.rates)
    return S.fill_both(wide, "cotacao").withColumn("cotacao", F.round("cotacao", 6))


def _series_correlation(j: Job):
    both = j.revenue_on_spine.join(j.rates_filled, "ano_mes", "inner")
    return S.correlation(both, "receita_mensal", "cotacao")


def _series_verdict(j: Job):
    c = _series_correlation(j)
    return c.withColumn("veredito", S.correlation_verdict("correlacao"))


def _rate_change(j: Job):
    r = S.change_first_last(j.rates_filled, "cotacao")
    return r.select("primeiro_mes", F.round("valor_primeiro", 6).alias("valor_primeiro"), "ultimo_mes",
                    F.round("valor_ultimo", 6).alias("valor_ultimo"), F.round("variacao_pct", 6).alias("variacao_pct"))


def _month_trend(j: Job):
    return M.month_trend(j.numbered, j.fit, "receita_mensal")


def _forecast(j: Job):
    return M.forecast(j.fit, 3)


def _trend_quality(j: Job):
    return M.trend_quality(j.numbered, j.fit, "receita_mensal")


def _ticket_histogram(j: Job):
    return D.histogram(j.orders, "valor_pedido", 50)


def _delivery_histogram(j: Job):
    d = j.orders.where(F.col("pedido_entregue") == 1)
    return D.histogram(d, "tempo_medio_entrega_dias", 40)


def _ticket_density(j: Job):
    return D.density(j.orders, "valor_pedido", 200)


def _payload_root(j: Job):
    return P.payload_root(j.orders)


def _payload_states(j: Job):
    return P.state_revenue_rows(j.orders_c)


def _payload_months(j: Job):
    return P.month_revenue_rows(j.orders)


def _payload_insights(j: Job):
    return P.payload_insights(j.orders)


def _payload_freight(j: Job):
    return P.freight_rows(j.orders_c, 5)


def _payload_late(j: Job):
    return P.late_rows(j.orders_c, j.p.min_orders, 5)


def _payload_states_map(j: Job):
    return P.payload_states(j.orders_c, j.p.focus_state)


def _payload_months_map(j: Job):
    return P.payload_months(j.orders)


def _payload_freight_map(j: Job):
    return P.payload_impact(P.freight_rows(j.orders_c, 5), "estado_cliente", "frete_texto", "frete_percentual", "estados_maior_frete")


def _payload_late_map(j: Job):
    rows = P.late_rows(j.orders_c, j.p.min_orders, 5)
    return P.payload_impact(rows, "estado_cliente", "taxa_texto", "taxa_atraso", "estados_maior_atraso")


def _change_log(j: Job):
    return j.change_log


def _change_log_view(j: Job):
    return G.change_log_view(j.change_log)


def _log_retention(j: Job):
    return G.retain(j.change_log, j.p.period.end, 90)


def _apply_changes(j: Job):
    return G.apply_changes(j.activity_old, j.change_log, "id_cliente")


_JOBS: list[Callable[[Job], DataFrame]] = [
    _kpi_totals, _order_facts, _delivery_days, _late_flag, _item_value, _item_freight_pct, _time_parts,
    _analytic_base, _sales_base, _api_base, _orders_dedup, _table_counts, _profile_shape, _profile_nulls,
    _profile_top_nulls, _profile_duplicates, _critical_orders, _monthly_revenue, _late_rate, _late_rate_known,
    _kpi_delivery, _kpi_freight, _executive_dashboard, _revenue_by_state, _orders_by_city, _city_normalized,
    _revenue_by_city, _revenue_by_seller, _revenue_by_category, _items_by_category, _ticket_by_state,
    _freight_share_by_state, _late_rate_by_state, _delivery_time_by_state, _delivery_time_by_state_orders,
    _revenue_by_status, _concentration_states, _concentration_sellers, _state_share, _state_report,
    _orders_by_weekday, _delivered_split, _late_split, _data_period, _view_state_summary, _view_month_summary,
    _view_critical_orders, _critical_orders_list, _view_delivery_performance, _kpi_snapshot, _month_summary,
    _formatted_kpis, _formatted_views, _cumulative_revenue, _mom_variation, _mom_growth, _falling_months,
    _mom_trimmed_mean, _first_last_month, _month_spine, _rate_monthly, _rate_filled, _series_correlation,
    _series_verdict, _rate_change, _month_trend, _forecast, _trend_quality, _ticket_histogram,
    _delivery_histogram, _ticket_density, _payload_root, _payload_states, _payload_months, _payload_insights,
    _payload_freight, _payload_late, _change_log, _change_log_view, _log_retention, _apply_changes,
    _city_respelled, _enriched_base, _dim_clientes_earliest, _text_cleaned, _text_keyed, _formatted_snapshot,
    _formatted_delivery, _month_spine_wide, _rate_filled_wide, _payload_states_map, _payload_months_map,
    _payload_freight_map, _payload_late_map,
]

DIMS = {"dim_clientes": _dim("dim_clientes"), "dim_produtos": _dim("dim_produtos"),
        "dim_vendedores": _dim("dim_vendedores"), "dim_tempo": _dim("dim_tempo")}


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {fn.__name__.lstrip("_"): _q(fn) for fn in _JOBS}
    out.update({k: _q(v) for k, v in DIMS.items()})
    return out
