"""Schema gate before any work (S8): what each input holds against what is declared.

Every input is opened by its reader and the schemas of all its files are merged (Spark reads the
footers in a job of its own), so a file that another program wrote with fewer or other columns is
found before a report runs. Findings are rows, one for each column; the required columns are read as
well and their nulls counted, in one pass for each table. An input that cannot be opened is one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, MISSING, EXTRA, RETYPED, ABSENT, UNREADABLE = "ok", "falta", "a mais", "outro tipo", "sem arquivo", "ilegivel"
REPORT = "tabela string, coluna string, esperado string, encontrado string, situacao string"


@dataclass(frozen=True)
class Input:
    """Where a table lies, its declared columns (DDL), and those that must not be null."""

    path: str
    columns: str
    required: tuple[str, ...] = ()
    format: str = "parquet"


def _open(spark: SparkSession, given: Input) -> DataFrame:
    reader = spark.read.format(given.format)
    if given.format == "csv":
        return reader.option("header", True).load(given.path)
    return reader.option("mergeSchema", True).load(given.path)


def schema_rows(name: str, given: Input, found: T.StructType) -> list[tuple]:
    """A row per declared or found column; names are compared as Spark compares them. Text formats have no
    types of their own, so only the names of their columns are compared."""
    expected = {f.name.lower(): (f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(given.columns).fields}
    own = {f.name.lower(): (f.name, f.dataType.simpleString()) for f in found.fields}
    rows = []
    for key in [*expected, *[k for k in own if k not in expected]]:
        want, got = expected.get(key), own.get(key)
        if want is None:
            state = EXTRA
        elif got is None:
            state = MISSING
        else:
            state = OK if want[1] == got[1] or given.format in ("csv", "text") else RETYPED
        rows.append((name, (want or got)[0], want[1] if want else None, got[1] if got else None, state))
    return rows


def input_report(spark: SparkSession, inputs: dict[str, Input]) -> DataFrame:
    """tabela, coluna, esperado, encontrado, situacao, and for required columns that are there: linhas, nulos."""
    rows, counts = [], []
    for name, given in inputs.items():
        try:
            df = _open(spark, given)
        except (PySparkException, Py4JJavaError) as e:
            gone = isinstance(e, PySparkException) and "PATH_NOT_FOUND" in (e.getCondition() or "")
            rows.append((name, None, None, None, ABSENT if gone else UNREADABLE))
            continue
        rows += schema_rows(name, given, df.schema)
        own = {c.lower(): c for c in df.columns}
        there = [own[c.lower()] for c in given.required if c.lower() in own]
        if there:
            one = df.agg(F.count("*").alias("linhas"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(there)])
            pairs = F.array(*[F.struct(F.lit(c.lower()).alias("chave"), F.col(f"n{i}").alias("nulos")) for i, c in enumerate(there)])
            counts.append(one.select(F.lit(name).alias("tabela"), "linhas", F.inline(pairs)))
    report = spark.createDataFrame(rows, REPORT)
    if not counts:
        return report.withColumn("linhas", F.lit(None).cast("bigint")).withColumn("nulos", F.lit(None).cast("bigint"))
    found = reduce(DataFrame.unionByName, counts)
    joined = report.withColumn("chave", F.lower("coluna")).join(found, ["tabela", "chave"], "left")
    return joined.select("tabela", "coluna", "esperado", "encontrado", "situacao", "linhas", "nulos")


def require(report: DataFrame, allow: tuple[str, ...] = (OK, EXTRA)) -> None:
    """Raises with every finding that is not allowed, nulls in required columns included; rows are columns of tables, so few."""
    bad = report.where(~F.col("situacao").isin(*allow) | (F.col("nulos") > 0)).orderBy("tabela", "coluna").collect()
    if bad:
        raise ValueError("inputs are not as declared: " + "; ".join(f"{r.tabela}.{r.coluna or '*'}: {r.situacao}, {r.nulos or 0} nulls" for r in bad))
