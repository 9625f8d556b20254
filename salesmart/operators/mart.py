"""Star schema: one item-level fact and four dimensions.

Dimensions are built from the keys the base actually uses. The customer
dimension keeps, per unique customer, the attributes of the earliest purchase
(T7): ``min_by`` is an aggregate (sort-based, as its keys are structs), so it
combines per task before the shuffle instead of a window that would sort
every row of a hot customer in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.columns import month_name, year_month
from salesmart.operators.cleaning import join_attributes
from salesmart.params import Period

# The star schema's column names by the raw inputs' names, which results must match.
FACT_COLUMNS = {
    "order_id": "id_pedido",
    "order_item_id": "id_item_pedido",
    "product_id": "id_produto",
    "seller_id": "id_vendedor",
    "customer_unique_id": "id_cliente",
    "data": "data",
    "order_status": "status_pedido",
    "price": "valor_produto",
    "freight_value": "valor_frete",
    "valor_total_item": "valor_total_item",
    "tempo_entrega_dias": "tempo_entrega_dias",
    "prazo_estimado_dias": "prazo_estimado_dias",
    "atraso_entrega_dias": "atraso_entrega_dias",
    "entregue_com_atraso": "entregue_com_atraso",
    "pedido_entregue": "pedido_entregue",
}
CUSTOMER_COLUMNS = {
    "customer_unique_id": "id_cliente",
    "customer_zip_code_prefix": "cep_prefixo_cliente",
    "customer_city": "cidade_cliente",
    "customer_state": "estado_cliente",
}
PRODUCT_COLUMNS = {
    "product_id": "id_produto",
    "product_category_name": "categoria_produto",
    "product_name_lenght": "tamanho_nome_produto",
    "product_description_lenght": "tamanho_descricao_produto",
    "product_photos_qty": "qtd_fotos_produto",
    "product_weight_g": "peso_produto_g",
    "product_length_cm": "comprimento_produto_cm",
    "product_height_cm": "altura_produto_cm",
    "product_width_cm": "largura_produto_cm",
}
SELLER_COLUMNS = {
    "seller_id": "id_vendedor",
    "seller_zip_code_prefix": "cep_prefixo_vendedor",
    "seller_city": "cidade_vendedor",
    "seller_state": "estado_vendedor",
}


class Mart(NamedTuple):
    fato: DataFrame
    dim_clientes: DataFrame
    dim_produtos: DataFrame
    dim_vendedores: DataFrame
    dim_tempo: DataFrame


def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Column subset with the mart's names."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns])


def fato_vendas(base: DataFrame) -> DataFrame:
    with_date = base.withColumn("data", F.to_date("order_purchase_timestamp"))
    return _rename(with_date, FACT_COLUMNS)


def dim_clientes(base: DataFrame) -> DataFrame:
    """One row per unique customer: attributes of the earliest (purchase, order)."""
    attrs = [c for c in CUSTOMER_COLUMNS if c != "customer_unique_id" and c in base.columns]
    first = F.min_by(F.struct(*attrs), F.struct("order_purchase_timestamp", "order_id"))
    d = (base.where(F.col("customer_unique_id").isNotNull())
         .groupBy("customer_unique_id").agg(first.alias("c"))
         .select("customer_unique_id", "c.*"))
    return _rename(d, CUSTOMER_COLUMNS)


def dim_clientes_by_key(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer dimension when the unique id is the customer key itself.

    Then every order of a customer carries the same attributes, so "earliest
    purchase wins" needs no per-customer ordering: the dimension is the
    customers that have orders, a semi join against the order keys (which
    collapse map-side) instead of shuffling every order to its customer.
    """
    # distinct first: each task ships one row per customer, so a hot customer stays small
    keys = orders.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()
    d = customers.join(keys, "customer_id", "left_semi").where(F.col("customer_unique_id").isNotNull())
    return _rename(d, CUSTOMER_COLUMNS)


def customers_as_dim(customers: DataFrame) -> DataFrame:
    """All customers under the dimension's names, for inner joins that keep only those with orders."""
    return _rename(customers.where(F.col("customer_unique_id").isNotNull()), CUSTOMER_COLUMNS)


def products_as_dim(products: DataFrame) -> DataFrame:
    """All products under the dimension's names, for joins that add attributes to given rows."""
    return _rename(products, PRODUCT_COLUMNS)


def sellers_as_dim(sellers: DataFrame) -> DataFrame:
    """All sellers under the dimension's names, for joins that add attributes to given rows."""
    return _rename(sellers, SELLER_COLUMNS)


def _dim_from_keys(base: DataFrame, key: str, attrs: DataFrame, mapping: dict[str, str]) -> DataFrame:
    keys = base.select(key).where(F.col(key).isNotNull()).distinct()
    return _rename(keys.join(attrs, key, "left"), mapping)


def dim_produtos(base: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct products sold, with their attributes."""
    return _dim_from_keys(base, "product_id", products, PRODUCT_COLUMNS)


def dim_vendedores(base: DataFrame, sellers: DataFrame) -> DataFrame:
    """Distinct sellers that sold, with their attributes."""
    return _dim_from_keys(base, "seller_id", sellers, SELLER_COLUMNS)


def time_parts(d) -> dict:
    """Date parts of the time dimension."""
    d = F.col(d) if isinstance(d, str) else d
    return {"ano": F.year(d), "mes": F.month(d), "nome_mes": month_name(d),
            "trimestre": F.quarter(d), "ano_mes": year_month(d)}


def dim_tempo(base: DataFrame) -> DataFrame:
    """One row per purchase date seen (not a full calendar)."""
    dates = (base.select(F.to_date("order_purchase_timestamp").alias("data"))
             .where(F.col("data").isNotNull()).distinct())
    return dates.withColumns(time_parts("data"))


def build_mart(base: DataFrame, products: DataFrame, sellers: DataFrame) -> Mart:
    return Mart(fato_vendas(base), dim_clientes(base), dim_produtos(base, products),
                dim_vendedores(base, sellers), dim_tempo(base))


def sales(mart: Mart, period: Period) -> DataFrame:
    """Fact rows of the period (F2).

    The date filter reaches the scan; when the stored fact is partitioned by
    ``ano_mes`` (``plans.store``) the month filter also prunes whole folders.
    """
    f = mart.fato.where(F.col("data").between(F.lit(period.start), F.lit(period.end)))
    if "ano_mes" in mart.fato.columns:
        f = f.where(F.col("ano_mes").between(period.first_month, period.last_month))
    return f


def translate_categories(dim_produtos: DataFrame, translation: DataFrame) -> DataFrame:
    """Add the English category name from the translation file.

    The lookup has one row per category; Spark broadcasts it when its size
    check passes, otherwise it is a plain join.
    """
    t = translation.select(F.col("product_category_name").alias("categoria_produto"),
                           F.col("product_category_name_english").alias("categoria_produto_en"))
    return dim_produtos.join(t, "categoria_produto", "left")


def sales_base(mart: Mart, period: Period) -> DataFrame:
    """Fact ⟕ the four dimensions, months of the period.

    Whole months are chosen by ``data`` itself, so the filter reaches the scans of
    the fact and of the time dimension, and rows without a date go. The time
    dimension has one row per calendar date, a bound that does not grow with the
    data, so it is broadcast.
    """
    first, last = F.lit(period.start.replace(day=1)), F.last_day(F.lit(period.end))
    f = mart.fato.where(F.col("data").between(first, last))
    if "ano_mes" in f.columns:
        f = f.where(F.col("ano_mes").between(period.first_month, period.last_month)).drop("ano_mes")
    for dim, key in ((mart.dim_clientes, "id_cliente"), (mart.dim_produtos, "id_produto"), (mart.dim_vendedores, "id_vendedor")):
        f = join_attributes(f, dim, key, "id_pedido")
    t = mart.dim_tempo.where(F.col("data").between(first, last))
    return f.join(F.broadcast(t), "data", "inner")
