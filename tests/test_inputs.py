"""Folder names, replaced files, paths with a scheme, plain decimal text."""

import shutil
from pathlib import Path

import pytest

from conftest import SF001
from salesmart.plans.queries import registry
from salesmart.sinks.writers import to_br_text
from salesmart.sources.files import first_existing, require_inputs


def _copy(to: str) -> str:
    shutil.copytree(SF001, to)
    for f in Path(to).iterdir():
        f.chmod(0o644)
    return to


def test_same_data_under_two_names(spark, tmp_out):
    a, b = _copy(f"{tmp_out}/sf100"), _copy(f"{tmp_out}/prod")
    f = registry()["late_rate_by_state"]
    assert sorted(map(str, f(spark, a).collect())) == sorted(map(str, f(spark, b).collect()))


def test_replaced_files_give_new_results(spark, tmp_out):
    d = _copy(f"{tmp_out}/data")
    f = registry()["kpi_totals"]
    before = f(spark, d).first()
    items = spark.read.parquet(f"{SF001}/lineitem.parquet")
    items.where("l_linenumber = 1").toPandas().to_parquet(f"{d}/lineitem.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(d)
    after = f(spark, d).first()
    assert before != after


def test_paths_with_a_scheme(spark):
    there = f"file://{SF001}/orders.parquet"
    assert first_existing(["file:///no/such/file", there]) == there
    require_inputs({"orders": there})
    with pytest.raises(FileNotFoundError):
        require_inputs({"x": "file:///no/such/file"})


def test_brazilian_doubles(spark):
    df = spark.createDataFrame([(15786203.57,), (0.0005,), (1e7,), (2.5,), (None,), (-1.25e-5,)], "v double")
    got = [r.v for r in to_br_text(df).collect()]
    assert got == ["15786203,57", "0,0005", "10000000,0", "2,5", None, "-0,0000125"]
