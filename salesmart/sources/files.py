"""File sources: raw CSVs, Brazilian CSV, exchange-rate JSON.

Every source has an explicit schema; nothing is inferred at scale.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, I, D = T.StringType(), T.StringType(), T.IntegerType(), T.DecimalType(12, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Timestamps arrive as text and are parsed with try_to_timestamp (bad -> NULL).
RAW_ORDERS = _schema(
    ("order_id", S), ("customer_id", S), ("order_status", S),
    ("order_purchase_timestamp", TS), ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS))
RAW_ITEMS = _schema(
    ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
    ("shipping_limit_date", TS), ("price", D), ("freight_value", D))
RAW_CUSTOMERS = _schema(
    ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
    ("customer_city", S), ("customer_state", S))
RAW_PRODUCTS = _schema(
    ("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
    ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", T.DoubleType()),
    ("product_length_cm", T.DoubleType()), ("product_height_cm", T.DoubleType()),
    ("product_width_cm", T.DoubleType()))
RAW_SELLERS = _schema(
    ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S))
CATEGORY_TRANSLATION = _schema(
    ("product_category_name", S), ("product_category_name_english", S))
RATE_JSON = T.StructType([T.StructField("value", T.ArrayType(_schema(
    ("cotacaoCompra", T.DoubleType()), ("cotacaoVenda", T.DoubleType()),
    ("dataHoraCotacao", S))), True)])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
             sep: str = ",", **options) -> DataFrame:
    """Header CSV with a fixed schema (S1, S3: a UTF-8 BOM is stripped by the reader)."""
    # a quote within a quoted field is doubled, not escaped by a backslash
    r = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"')
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path if isinstance(path, str) else list(path))


def read_csv_br(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``;``-separated CSV with decimal comma (K3 read-back).

    Only DecimalType fields parse with the pt-BR locale; doubles would turn NULL.
    """
    return read_csv(spark, path, schema, sep=";", locale="pt-BR")


def read_csv_br_exact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``;``-separated CSV with decimal comma, doubles included (K3 read-back): numbers are read as text, dots that group
    digits go, the comma becomes a point, and the text is cast; a text that is no number gives NULL."""
    text = read_csv(spark, path, T.StructType([T.StructField(f.name, S) for f in schema.fields]), sep=";")
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            c = F.translate(c, ",.", ".")
        cols.append(c.try_cast(f.dataType).alias(f.name))
    return text.select(*cols)


def exists(path: str) -> bool:
    """Whether a path exists on the file system its scheme names."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return os.path.exists(path.removeprefix("file://"))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def first_existing(paths: Sequence[str]) -> str:
    """First path that exists (S7), else FileNotFoundError listing all tried."""
    for p in paths:
        if exists(p):
            return p
    raise FileNotFoundError(f"none of these inputs exists: {list(paths)}")


def require_inputs(paths: dict[str, str]) -> None:
    """Fail before any work when an input is missing."""
    missing = [f"{k}: {p}" for k, p in paths.items() if not exists(p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + "; ".join(missing))


def read_rates_json(spark: SparkSession, path: str) -> DataFrame:
    """Exchange-rate JSON body -> (data, dolar_compra, dolar_venda, ano_mes)."""
    raw = spark.read.schema(RATE_JSON).option("multiLine", True).json(path)
    q = raw.select(F.explode("value").alias("q"))
    d = F.to_date(F.substring_index(F.col("q.dataHoraCotacao"), " ", 1))
    return q.select(d.alias("data"), F.col("q.cotacaoCompra").alias("dolar_compra"),
                    F.col("q.cotacaoVenda").alias("dolar_venda")).withColumn(
        "ano_mes", F.date_format("data", "yyyy-MM"))


# The reference's fallback monthly dollar rates, 2017-01 .. 2018-08.
FALLBACK_RATES = [
    ("2017-01", 3.15), ("2017-02", 3.12), ("2017-03", 3.18), ("2017-04", 3.22),
    ("2017-05", 3.25), ("2017-06", 3.28), ("2017-07", 3.30), ("2017-08", 3.32),
    ("2017-09", 3.18), ("2017-10", 3.15), ("2017-11", 3.20), ("2017-12", 3.30),
    ("2018-01", 3.25), ("2018-02", 3.28), ("2018-03", 3.32), ("2018-04", 3.45),
    ("2018-05", 3.50), ("2018-06", 3.60), ("2018-07", 3.72), ("2018-08", 3.85),
]


def fallback_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK_RATES, "ano_mes string, dolar_venda double")
