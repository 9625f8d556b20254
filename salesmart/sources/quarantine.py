"""CSV scan that loses no line (S1, S2): typed rows, and the lines that do not fit, with their reasons.

The file is read once, as text columns with a column for malformed records (too few or too many
fields). Every text is then cast to its declared type without raising; a text that is there but does
not fit makes its line a reject that names the column. Both kinds go to one stored table, so the rows
that go on and the rejects come from the same reading and add up to all lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.session import shared_path

RECORD = "_registro"
#: Reason of a line whose number of fields is not that of the schema.
MALFORMED = "registro"


def _typed(text: Column, dtype: T.DataType, pattern: str | None) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) and pattern:
        return F.try_to_timestamp(text, F.lit(pattern)).cast(dtype)
    return text.try_cast(dtype)


def read_csv_split(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True, patterns: Mapping[str, str] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema``; rejects: arquivo, motivos, textos, registro).

    ``motivos`` are the columns whose text does not fit, in the order of the schema, or ``registro`` for a malformed line;
    ``textos`` holds those columns' texts, ``registro`` a malformed line as it stands. ``patterns`` gives the format of a date column."""
    patterns = patterns or {}
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(RECORD, T.StringType())])
    reader = spark.read.schema(text).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    reader = reader.option("escape", '"')  # a quote within quotes is doubled, as spreadsheets and pandas write it
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.csv(path)
    values = [_typed(F.col(f"`{f.name}`"), f.dataType, patterns.get(f.name)).alias(f.name) for f in schema.fields]
    whole = F.col(RECORD).isNull()
    misfit = [F.when(whole & F.col(f"`{f.name}`").isNotNull() & v.isNull(), F.lit(f.name)) for f, v in zip(schema.fields, values)]
    reasons = F.array_compact(F.array(F.when(~whole, F.lit(MALFORMED)), *misfit))
    texts = F.create_map(*[x for f in schema.fields for x in (F.lit(f.name), F.col(f"`{f.name}`"))])
    both = raw.select(
        F.struct(*values).alias("linha"), reasons.alias("motivos"), F.col("_metadata.file_path").alias("arquivo"), F.col(RECORD).alias("registro"),
        F.map_filter(texts, lambda k, _: F.array_contains(reasons, k)).alias("textos"),
    )
    stored = shared_path(spark, f"csv-split-{uuid.uuid4().hex}")
    both.withColumn("rejeitada", F.size("motivos") > 0).write.partitionBy("rejeitada").parquet(stored)
    types = T.StructType([*both.schema.fields, T.StructField("rejeitada", T.BooleanType())])
    split = spark.read.schema(types).parquet(stored)
    return split.where("not rejeitada").select("linha.*"), split.where("rejeitada").select("arquivo", "motivos", "textos", "registro")
