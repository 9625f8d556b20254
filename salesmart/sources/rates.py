"""External rates from nested JSON bodies, with a literal table where a body fails.

The bodies lie in folders by year (``ano=2017/...``), one JSON document in a file. A document that cannot
be parsed, or has no ``value``, is a failed one, and does not stop the others. The literal table stands in
for the years without a sound body, and for no other month: a month that a sound body leaves out stays
empty. Every month tells where its rate comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.sources.files import RATE_JSON, exists

BROKEN = "_corpo"
FROM_JSON, FROM_TABLE = "json", "tabela"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(ano, arquivo, value, falhou) of each body; value is null where the body failed."""
    schema = T.StructType([*RATE_JSON.fields, T.StructField(BROKEN, T.StringType()), T.StructField("ano", T.IntegerType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    failed = F.col(BROKEN).isNotNull() | F.col("value").isNull()
    return raw.select("ano", F.col("_metadata.file_path").alias("arquivo"), F.when(~failed, F.col("value")).alias("value"), failed.alias("falhou"))


def monthly_rates(bodies: DataFrame) -> DataFrame:
    """Mean selling rate by month of the sound bodies."""
    quotes = bodies.where(~F.col("falhou")).select(F.explode("value").alias("q"))
    day = F.try_to_timestamp(F.substring_index("q.dataHoraCotacao", " ", 1), F.lit("yyyy-MM-dd"))
    return quotes.select(F.date_format(day, "yyyy-MM").alias("ano_mes"), F.col("q.cotacaoVenda").alias("v")).groupBy("ano_mes").agg(F.avg("v").alias("taxa"))


def rates_or_table(spark: SparkSession, path: str, months: DataFrame, literal: DataFrame) -> DataFrame:
    """ano_mes, taxa, origem for each of ``months`` (ano_mes). ``literal``: (ano_mes, dolar_venda). If nothing
    lies at ``path``, all months come from the table."""
    if not exists(path):
        read = months.withColumn("taxa", F.lit(None).cast("double")).withColumn("_lido", F.lit(False))
    else:
        bodies = read_bodies(spark, path)
        sound = bodies.where(~F.col("falhou")).select(F.col("ano").cast("string").alias("_ano"), F.lit(True).alias("_lido")).distinct()
        read = months.join(monthly_rates(bodies), "ano_mes", "left").withColumn("_ano", F.substring("ano_mes", 1, 4)).join(sound, "_ano", "left")
    read = read.join(literal.select("ano_mes", "dolar_venda"), "ano_mes", "left")
    table = ~F.coalesce(F.col("_lido"), F.lit(False)) & F.col("dolar_venda").isNotNull()
    return read.select(
        "ano_mes", F.when(table, F.col("dolar_venda")).otherwise(F.col("taxa")).alias("taxa"),
        F.when(table, F.lit(FROM_TABLE)).when(F.col("taxa").isNotNull(), F.lit(FROM_JSON)).alias("origem"),
    )
